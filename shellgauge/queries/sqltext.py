"""The command log and its columns in DuckDB SQL, for comparison with the Spark queries."""

from __future__ import annotations

from ..functions import audit as A
from ..functions import features as X
from ..functions import grader as G
from ..functions import normalize as N
from ..plans import rules as R


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def matches(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {lit(pattern)})"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(lit(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def generated_ctes() -> list[str]:
    """gen (rule_id, category, idx, command): all rules' products, spaced, not yet deduplicated."""
    rules = [*R.RULES, *R.SAFE_RULES]
    slots = [(i, k, n, p, v, len(vs)) for i, _, _, s, _ in rules for k, (n, vs) in enumerate(s.items()) for p, v in enumerate(vs)]
    out = [
        f"rules(rule_id, category, template, lim) as (values {values([(i, c, t, lim) for i, c, t, _, lim in rules])})",
        f"slots(rule_id, slot_no, slot, pos, val, size) as (values {values(slots)})",
        "p0 as (select rule_id, category, lim, template as command, 0 as idx, 1 as n from rules)",
    ]
    depth = max(len(r[3]) for r in rules)
    for k in range(depth):
        out.append(f"p{k + 1} as (select p.rule_id, category, lim, case when slot is null then command else replace(command, '{{' || slot || '}}', val) end as command, idx * coalesce(size, 1) + coalesce(pos, 0) as idx, n * coalesce(size, 1) as n from p{k} p left join slots s on s.rule_id = p.rule_id and s.slot_no = {k})")
    out.append(f"gen as (select rule_id, category, idx, trim(command) as command from p{depth} where n <= lim or idx = 0 or (idx * lim) // n > ((idx - 1) * lim) // n)")
    return out


def command_ctes() -> list[str]:
    curated = [(1000 + s, "", p, c) for s, cs in enumerate(R.CURATED.values()) for p, c in enumerate(cs)]
    return [
        *generated_ctes(),
        f"cur(rule_id, category, idx, command) as (values {values(curated)})",
        f"tax(category, risk) as (values {values([(n, r) for n, r, _ in R.TAXONOMY])})",
        "firsts as (select *, row_number() over (partition by command order by rule_id, idx) as k from (select * from gen union all select * from cur))",
        "commands as (select row_number() over (order by rule_id, idx) - 1 as pos, command, f.category, coalesce(risk, 0)::int as risk, case when rule_id < 100 then 'grammar' else 'negatives' end as source from firsts f left join tax t on f.category = t.category where k = 1)",
    ]


def log_ctes() -> list[str]:
    return [
        *command_ctes(),
        "log as (select event_id, ts, user_id, event_type, case event_id % 7 when 1 then 'OWNER=u' || user_id || ' ' || command when 2 then command || ' && echo done ' || user_id"
        " when 3 then 'cd /srv/u' || user_id || ';  ' || command when 5 then upper(command) else command end as command, category, risk, source"
        " from events join commands on (event_id * 7 + user_id) % (select max(pos) + 1 from commands) = pos)",
    ]


def clean_piece(t: str, latin: bool = False) -> str:
    c = f"regexp_replace(regexp_replace({t}, '[\\t\\x0B\\f\\r\\n]', ' ', 'g'), '[\\x00-\\x1F\\x7F]', '', 'g')"
    if latin:
        c = f"regexp_replace(strip_accents({c}), '[^\\x20-\\x7E]', '', 'g')"
    return f"trim(regexp_replace(lower({c}), ' {{2,}}', ' ', 'g'), ' ')"


_OPERATORS = "t in ('&&', '||', ';', '|', '&', chr(10), chr(13))"


def norm_cte(table: str, column: str = "command", latin: bool = False, name: str = "norm") -> str:
    """All columns of a table and text, unquoted, segments. Commands hold no escapes and no characters but ASCII (or Latin ones)."""
    piece = f"case when t in (chr(13), chr(10), ';') then ' ; ' when t in ('&&', '||', '|', '&') then ' ' || t || ' ' else {clean_piece('t', latin)} end"
    return (
        f"{name} as (select *, replace(replace(text, '''', ''), '\"', '') as unquoted from (select * exclude (toks), trim(regexp_replace(array_to_string(list_transform(toks, lambda t: {piece}), ' '), ' {{2,}}', ' ', 'g'), ' ') as text,"
        f" list_filter(list_transform(list_filter(toks, lambda t: not ({_OPERATORS})), lambda t: {clean_piece('t', latin)}), lambda s: s <> '') as segments"
        f" from (select *, regexp_extract_all({column}, {lit(N.TOKENS)}) as toks from {table})))"
    )


def grams_of(view: str) -> str:
    return "list_concat(" * 3 + ", ".join([f"list_transform(range(1, length({view}) - {X.SIZES[0]} + 2), lambda i: substr({view}, i, {X.SIZES[0]}))", *[f"list_transform(range(1, length({view}) - {n} + 2), lambda i: substr({view}, i, {n})))" for n in X.SIZES[1:]]])


def grams_cte(key: str = "event_id", table: str = "norm", name: str = "grams") -> str:
    return f"{name} as (select {key}, unnest(list_distinct(list_concat({grams_of('text')}, {grams_of('unquoted')}))) as gram from {table})"


def _contains_any(c: str, tokens) -> str:
    return "(" + " or ".join(f"contains({c}, {lit(t)})" for t in tokens) + ")"


def _first_of(c: str, tokens) -> str:
    return "case " + " ".join(f"when contains({c}, {lit(t)}) then {lit(t.strip())}" for t in tokens) + " end"


def grade(c: str) -> tuple[str, str]:
    """(risk, rule) of a command."""
    lc = f"lower({c})"
    rec = _contains_any(lc, G.RECURSIVE)
    rel = f"(contains({lc}, './') or " + " or ".join(f"ends_with(rtrim({lc}), {lit(e)})" for e in G.RELATIVE_END) + ")"
    cases = [
        (matches(lc, G.PIPE_TO_SHELL), 2, "'pipe_to_shell'"),
        (_contains_any(lc, G.DESTRUCTIVE), 2, f"'destructive_verb:' || {_first_of(lc, G.DESTRUCTIVE)}"),
        (f"{rec} and {_contains_any(lc, G.DISPOSABLE)}", 0, "'delete_disposable_target'"),
        (f"{rec} and {matches(lc, G.BLOCK_DEVICE)}", 2, "'delete_block_device'"),
        (f"{rec} and {matches(lc, G.WILDCARD)}", 2, "'delete_wildcard'"),
        (f"{rec} and {matches(lc, G.SYSTEM_PATH)}", 2, "'delete_system_path'"),
        (f"{rec} and {rel}", 1, "'delete_relative_path'"),
        (rec, 1, "'delete_unknown_target'"),
        (matches(lc, G.PLAIN_WILDCARD), 2, "'delete_wildcard_no_recursive'"),
        (_contains_any(lc, G.RISKY), 1, f"'risky_verb:' || {_first_of(lc, G.RISKY)}"),
        (f"{matches(lc, G.SYSTEM_PATH)} and {_contains_any(lc, G.MUTATING)}", 1, "'touches_system_path'"),
    ]
    risk = "case " + " ".join(f"when {k} then {r}" for k, r, _ in cases) + " else 0 end"
    rule = "case " + " ".join(f"when {k} then {n}" for k, _, n in cases) + " else 'default_safe' end"
    return risk, rule


def dense_columns() -> dict[str, str]:
    """Each dense feature over text and target."""
    flag = lambda s: f"({s})::int::double"
    count = lambda s: f"((length(text) - length(replace(text, {lit(s)}, ''))) // {len(s)})"
    out = {k: flag(matches("text", p)) for k, p in X.FLAGS.items()}
    out |= {
        "segment_count": "len(segments)::double",
        "delete_target_system_path": flag(matches("target", X.SYSTEM_PATH)),
        "delete_target_home": flag(matches("target", X.HOME_PATH)),
        "delete_target_wildcard": flag(matches("target", X.WILDCARD)),
        "delete_target_relative": flag(matches("target", X.RELATIVE)),
        "delete_target_disposable": flag(matches("target", X.DISPOSABLE)),
        "dd_to_block_device": flag(f"{matches('text', X.FLAGS['has_dd'])} and {matches('text', X.FLAGS['block_device'])}"),
        "subshell_depth": f"({count('$(')} + {count('${')})::double",
        "backtick_count": f"{count('`')}::double",
        "quote_nesting": f"(({count(chr(34))} + {count(chr(39))}) // 2)::double",
        "flag_density": f"len(regexp_extract_all(text, {lit(X.FLAG_TOKEN)}))::double / greatest(1, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')))",
        "path_depth": f"least(coalesce(list_max(list_transform(regexp_extract_all(text, {lit(X.PATH_TOKEN)}), lambda p: length(p) - length(replace(p, '/', '')))), 0), {X.MAX_PATH_DEPTH})::double",
        "mentions_only": flag(f"{matches('text', X.DANGER_WORD)} and not {matches('text', X.DANGER_VERB)}"),
    }
    return {n: out[n] for n in X.DENSE}


def dense_cte(table: str = "norm", name: str = "dense") -> str:
    target = f"coalesce(list_filter(segments, lambda s: {matches('s', X.RM_WORD)})[1], array_to_string(segments, ' '))"
    return f"{name} as (select * exclude (target), {', '.join(f'{e} as {n}' for n, e in dense_columns().items())} from (select *, {target} as target from {table}))"


def without_prints(c: str) -> str:
    """Bracket depth as a running state over tokens, in a list that is reduced."""
    mark = f"chr({ord(A.MARK)})"
    tokens = f"regexp_extract_all(regexp_replace(replace({c}, {mark}, ''), {lit(A.PRINT)}, {mark}, 'g'), {lit(A.TOKENS)})"
    states = f"list_prepend({{'o': '', 'd': 0, 't': ''}}, list_transform({tokens}, lambda t: {{'o': '', 'd': 0, 't': t}}))"
    inside = f"(a.d > 0 or b.t = {mark})"
    depth = f"case when {inside} then a.d + case when b.t in ({mark}, '(', '[', '{{') then 1 when b.t in (')', ']', '}}') then -1 else 0 end else 0 end"
    cut = f"list_reduce({states}, lambda a, b: {{'o': case when {inside} then a.o else a.o || b.t end, 'd': {depth}, 't': ''}}).o"
    return f"case when {matches(c, A.PRINT)} then {cut} else {c} end"


def audit_cte(table: str, column: str = "command", name: str = "audited") -> str:
    shows = f"{matches(column, A.DISPLAY)} and not {matches(column, A.PIPE_OUT)} and not {matches(column, A.REDIRECT_OUT)}"
    plain = f"regexp_replace({without_prints(column)}, {lit(A.QUOTED)}, ' ', 'g')"
    whens = []
    for n, p in A.RULES:
        c = column if n in A.RAW else "plain"
        # RE2 has no look-ahead: the dd half of the rule goes through all targets of all dd segments instead
        simple, _, dd = p.partition(r"|\bdd\b[^;|&]*")
        fires = matches(c, simple)
        if "(?!" in dd:
            of, _, harmless = dd.partition("(?!")
            every = f"(list_transform(regexp_extract_all({c}, {lit(r'\bdd\b[^;|&]*')}), lambda s: string_split_regex(s, {lit(of)})[2:]))"
            fires = f"({fires} or len(list_filter(flatten({every}), lambda t: {matches('t', '^[a-z]')} and not {matches('t', '^(?:' + harmless.partition(')')[0] + ')')})) > 0)"
        elif dd:
            fires = matches(c, p)
        whens.append(f"when {fires} then '{n}'")
    return f"{name} as (select * exclude (plain), case when display_only then null {' '.join(whens)} end as rule from (select *, {plain} as plain, {shows} as display_only from {table}))"


def with_ctes(ctes: list[str], body: str) -> str:
    """Each table is computed once, however many of the later ones read it."""
    return "with " + ",\n".join(c.replace(" as (", " as materialized (", 1) for c in ctes) + "\n" + body
