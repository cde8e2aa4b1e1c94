"""Queries on sources, generation, normalisation, labels, audit and corpus assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import audit as A
from ..functions import grader as G
from ..functions import normalize as N
from ..functions import transforms as T
from ..operators import corpus as C
from ..operators import generate as Gen
from ..plans import rules as R
from ..sources import seed as S
from ..sources import tables as Tab
from . import sqltext as Q

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


log = Gen.command_log
LOG = Q.log_ctes()
GRADE, RULE = Q.grade("command")

# Lines of command lists, made from the log: headings, comments, blank lines, labels and bad labels.


def seed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    heads = F.element_at(F.array(*[F.lit(f"# === {w} ===") for w in ("everyday work", "done by mistake", "I am afraid of these", "looks dangerous, is not", "no label", "misc")]), (F.floor(k / 40) % 6 + 1).cast("int"))
    label = F.element_at(F.array(*[F.lit(x) for x in ("safe", "Risky", " destructive ", "unsure")]), (F.floor(k / 3) % 4 + 1).cast("int"))
    value = F.when(k % 40 == 0, heads).when(k % 17 == 0, F.concat(F.lit("#  "), "command")).when(k % 13 == 0, F.lit("   ")).when(k % 3 == 0, F.concat(F.lit("  "), "command", F.lit(" ||| "), label)).otherwise(F.col("command"))
    return log(spark, sf_dir).select(F.concat(F.lit("list"), (F.floor(k / 2000)).cast("string")).alias("path"), (k % 2000).cast("int").alias("line"), value.alias("value"))


def read_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's lines as text files, read again by the reader; lines count from 0 here."""
    folder = Tab.shared_path(spark, "lists")
    S.write_lines(seed_lines(spark, sf_dir), folder)
    lines = S.read_lines(spark, folder).withColumn("path", F.regexp_extract("path", "path=([^/]+)/", 1))
    return lines.withColumn("line", F.col("line") - 1)


_SECTION = "case " + " ".join(f"when contains(upper(h), '{w}') then '{n}'" for w, n in S.SECTIONS) + " else 'other:' || trim(h) end"
SEED = [
    *LOG,
    "lines as (select 'list' || (event_id // 2000) as path, (event_id % 2000)::int as line, case when event_id % 40 = 0 then ['# === everyday work ===', '# === done by mistake ===', '# === I am afraid of these ===', '# === looks dangerous, is not ===', '# === no label ===', '# === misc ==='][(event_id // 40) % 6 + 1]"
    " when event_id % 17 = 0 then '#  ' || command when event_id % 13 = 0 then '   ' when event_id % 3 = 0 then '  ' || command || ' ||| ' || ['safe', 'Risky', ' destructive ', 'unsure'][(event_id // 3) % 4 + 1] else command end as value from log)",
    "trimmed as (select path, line, trim(value) as t from lines where trim(value) <> '')",
    f"headed as (select *, case when h <> '' then {_SECTION} end as sec from (select *, regexp_extract(t, '^#\\s*===\\s*(.+?)\\s*===$', 1) as h from trimmed))",
    "carried as (select *, coalesce(last_value(sec ignore nulls) over (partition by path order by line rows between unbounded preceding and current row), 'unlabelled') as section from headed)",
    "cutup as (select path, line, section, trim(case when contains(t, '|||') then substr(t, 1, position('|||' in t) - 1) else t end) as command, case when contains(t, '|||') then lower(trim(substr(t, position('|||' in t) + 3))) end as label_text from carried where not starts_with(t, '#'))",
    "parsed as (select *, case label_text when 'safe' then 0 when 'risky' then 1 when 'destructive' then 2 end as label from cutup where command <> '')",
]


@query(Q.with_ctes(SEED, "select path, line, section, command, label_text, label::int as label from parsed"))
def s01_s02_seed_lines(spark, sf_dir):
    """Command lists as text files, one for each 2000 events, through the reader."""
    return S.parse_seed(read_seed(spark, sf_dir))


@query(Q.with_ctes(SEED, "select path, line, label_text from parsed where label is null and label_text is not null"))
def s03_bad_labels(spark, sf_dir):
    return S.bad_labels(S.parse_seed(seed_lines(spark, sf_dir)))


@query(Q.with_ctes(SEED, "select section, coalesce(label, -1)::int as label, count(*) as n from parsed group by 1, 2"))
def s05_section_counts(spark, sf_dir):
    return S.section_counts(S.parse_seed(seed_lines(spark, sf_dir)))


@query(Q.with_ctes(SEED, "select path, line, command from parsed"))
def s06_plain_commands(spark, sf_dir):
    return S.plain_commands(S.parse_seed(seed_lines(spark, sf_dir)))


@query(Q.with_ctes([*LOG, Q.audit_cte("log")], "select event_id, command from audited where rule is null"))
def s07_gated_rows(spark, sf_dir):
    """The log without its rejected rows, written through the gate and read again."""
    good = A.audit(log(spark, sf_dir)).where("rule is null").select("event_id", "command")
    path = Tab.shared_path(spark, "gated")
    A.write_gated(good, path)
    return spark.read.schema(good.schema).parquet(path)


@query(Q.with_ctes(LOG, "select command, risk::int as label, category, source, '' as section, '' as transform, count(*) as n from log group by all"))
def s08_s09_corpus_file(spark, sf_dir):
    """Corpus rows written as CSV files and read again."""
    rows = log(spark, sf_dir).select("command", F.col("risk").alias("label"), "category", "source", F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("transform"))
    path = Tab.shared_path(spark, "corpus")
    Tab.write_corpus(rows, path)
    read = Tab.read_corpus(spark, path).fillna("", ["category"])
    return read.groupBy("command", "label", "category", "source", "section", "transform").agg(F.count("*").alias("n"))


@query(Q.with_ctes(LOG, "select l.rule_id, count(*) as uses, count(distinct l.command) as commands from (select f.rule_id, log.command from log join (select rule_id, command from firsts where k = 1) f on f.command = log.command) l group by 1"))
def s14_generated_uses(spark, sf_dir):
    """Which rules' commands the log has word for word: the whole product against the whole log."""
    made = Gen.generated(spark).unionByName(Gen.safe_side(spark))
    made = C.first_wins(made.select("command", "rule_id", "idx"), ["command"], ["rule_id", "idx"])
    return log(spark, sf_dir).join(F.broadcast(made), "command").groupBy("rule_id").agg(F.count("*").alias("uses"), F.count_distinct("command").alias("commands"))


@query(Q.with_ctes([*LOG, "spaced as (select event_id, ts, row_number() over (partition by user_id order by event_id) - 1 as i, count(*) over (partition by user_id) as n from log)"], "select event_id, n from spaced where n <= 5 or i = 0 or (i * 5) // n > ((i - 1) * 5) // n"))
def s15_evenly_spaced(spark, sf_dir):
    """At most five evenly spaced events of each user."""
    from pyspark.sql import Window

    rows = log(spark, sf_dir).select("event_id", "user_id")
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    step = lambda i: F.floor(i * 5 / F.col("n"))
    return rows.where((F.col("n") <= 5) | (F.col("i") == 0) | (step(F.col("i")) > step(F.col("i") - 1))).select("event_id", "n")


@query(Q.with_ctes(LOG, "select source, risk, category, count(*) as n, count(distinct user_id) as users from log group by all"))
def s16_s20_log_by_category(spark, sf_dir):
    return log(spark, sf_dir).groupBy("source", "risk", "category").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query(Q.with_ctes(LOG, "select t.category, t.risk::int as risk, count(event_id) as n from tax t left join log on log.category = t.category group by all"))
def s20_taxonomy_coverage(spark, sf_dir):
    own = log(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))
    return Gen.taxonomy(spark).join(own, "category", "left").select("category", "risk", F.coalesce("n", F.lit(0)).alias("n"))


# Normalisation, over the log and over whole documents.


def norm(spark, sf_dir):
    return N.normalize_commands(log(spark, sf_dir))


NORM = [*LOG, Q.norm_cte("log")]
DOCS = [Q.norm_cte("documents", "text_", latin=True).replace("from documents", "from (select doc_id, coalesce(text, '') as text_ from documents)")]


def norm_documents(spark, sf_dir):
    docs = Tab.dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text_")))
    return N.normalize_commands(docs, "text_")


@query(Q.with_ctes(NORM, "select event_id, text, unquoted, array_to_string(segments, chr(10)) as segments from norm"))
def n12_normalized_log(spark, sf_dir):
    return norm(spark, sf_dir).select("event_id", "text", "unquoted", F.array_join("segments", "\n").alias("segments"))


@query(Q.with_ctes(DOCS, "select doc_id, md5(text) as text_md5, length(text) as n_text, md5(unquoted) as unquoted_md5, len(segments)::int as n_segments, md5(array_to_string(segments, chr(10))) as segments_md5, length(regexp_replace(strip_accents(text_), '[\\x20-\\x7E]', '', 'g'))::int as dropped_non_ascii from norm"))
def n12_normalized_documents(spark, sf_dir):
    out = norm_documents(spark, sf_dir)
    return out.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_text"), F.md5("unquoted").alias("unquoted_md5"), F.size("segments").alias("n_segments"), F.md5(F.array_join("segments", "\n")).alias("segments_md5"), "dropped_non_ascii")


@query(Q.with_ctes(DOCS, "select doc_id from norm where regexp_matches(text, '[^\\x20-\\x7E]')"))
def n13_ascii_violations(spark, sf_dir):
    return norm_documents(spark, sf_dir).where(F.col("text").rlike(r"[^\x20-\x7E]")).select("doc_id")


@query(f"select t as token, count(*) as n from (select unnest(regexp_extract_all(coalesce(text, ''), {Q.lit(N.TOKENS)})) as t from conversations) where t in ('&&', '||', ';', '|', '&', chr(10), chr(13)) group by 1")
def n02_n03_operators(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.explode(N.tokens(F.coalesce("text", F.lit("")))).alias("token"))
    return turns.where(F.col("token").isin(*N.OPERATORS)).groupBy("token").agg(F.count("*").alias("n"))


@query(Q.with_ctes(NORM, "select event_id, (i - 1)::int as place, segments[i] as segment from (select event_id, segments, unnest(range(1, len(segments) + 1)) as i from norm)"))
def n08_segments(spark, sf_dir):
    return norm(spark, sf_dir).select("event_id", F.posexplode("segments").alias("place", "segment"))


@query("select page_id, length(x)::int as n, md5(x) as x_md5 from (select page_id, trim(regexp_replace(lower(regexp_replace(strip_accents(regexp_replace(regexp_replace(coalesce(html, ''), '[\\t\\x0B\\f\\r\\n]', ' ', 'g'), '[\\x00-\\x1F\\x7F]', '', 'g')), '[^\\x20-\\x7E]', '', 'g')), ' {2,}', ' ', 'g'), ' ') as x from pages)")
def n04_n06_cleaned_pages(spark, sf_dir):
    """Controls, folding, lower case and spaces over whole pages."""
    out = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", N.clean_piece(F.coalesce("html", F.lit(""))).alias("x"))
    return out.select("page_id", F.length("x").alias("n"), F.md5("x").alias("x_md5"))


@query(Q.with_ctes(LOG, "select event_id, command from log"))
def n01_escapes_removed(spark, sf_dir):
    """Terminal escapes put around the log's commands go again."""
    esc = "\x1b"
    coloured = F.concat(F.lit(f"{esc}[1;31m"), "command", F.lit(f"{esc}[0m{esc}]0;title\x07{esc}(B"))
    return log(spark, sf_dir).select("event_id", N.strip_escapes(coloured).alias("command"))


# Weak labels.


def graded(spark, sf_dir):
    return G.graded(log(spark, sf_dir))


GRADED = [*LOG, f"graded as (select *, {GRADE} as graded, {RULE} as rule from log)"]


@query(Q.with_ctes(GRADED, "select event_id, graded::int as graded, rule from graded"))
def l01_grades(spark, sf_dir):
    return graded(spark, sf_dir).select("event_id", "graded", "rule")


@query(Q.with_ctes(GRADED, "select event_type, graded::int as risk, rule, count(*) as n, count(distinct user_id) as users from graded group by all"))
def flagship_risk_by_event_type(spark, sf_dir):
    """Counts of the graded log by event type, risk and rule."""
    return graded(spark, sf_dir).groupBy("event_type", F.col("graded").alias("risk"), "rule").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


SETTLED = [*SEED, f"settled as (select path, line, section, label, graded, rule, coalesce(label, case section when 'routine' then 0 when 'looks_scary' then 0 when 'accident' then 1 when 'feared' then 1 end, graded) as settled from (select *, {GRADE} as graded, {RULE} as rule from parsed))"]


def settled(spark, sf_dir):
    out = G.graded(S.parse_seed(seed_lines(spark, sf_dir)))
    return out.withColumn("settled", G.settled_label(F.col("label"), F.col("section"), F.col("graded")))


@query(Q.with_ctes(SETTLED, "select path, line, settled::int as settled from settled"))
def l02_settled_labels(spark, sf_dir):
    return settled(spark, sf_dir).select("path", "line", "settled")


@query(Q.with_ctes(SETTLED, "select count(*) filter (label = graded) as agree, count(*) filter (label <> graded) as disagree, round(avg((label = graded)::int), 4) as rate from settled where label is not null"))
def l03_agreement(spark, sf_dir):
    known = settled(spark, sf_dir).where("label is not null")
    return known.agg(F.count_if(F.expr("label = graded")).alias("agree"), F.count_if(F.expr("label <> graded")).alias("disagree"), F.round(F.avg(F.expr("cast(label = graded as int)")), 4).alias("rate"))


@query(Q.with_ctes(GRADED, "select rule, count(*) as n from graded group by 1 order by n desc, rule limit 12"))
def l04_top_rules(spark, sf_dir):
    return C.top_groups(graded(spark, sf_dir), "rule", 12)


@query(Q.with_ctes(SETTLED, "select path, line, label::int as label, graded::int as graded, rule from settled where label <> graded order by path, line limit 40"))
def l05_first_disagreements(spark, sf_dir):
    return settled(spark, sf_dir).where("label <> graded").orderBy("path", "line").limit(40).select("path", "line", "label", "graded", "rule")


# Corpus assembly.


def parts(spark, sf_dir) -> list[DataFrame]:
    s, own = settled(spark, sf_dir), log(spark, sf_dir)
    base = lambda d, label, category, source, section, pos: d.select("command", label.cast("int").alias("label"), category.alias("category"), F.lit(source).alias("source"), section.alias("section"), F.lit("").alias("transform"), pos.alias("pos"))
    none = F.lit("")
    place = F.regexp_extract("path", r"(\d+)$", 1).cast("long") * 2000 + F.col("line")
    return [
        base(s.where("label is not null"), F.col("label"), none, "seed", F.col("section"), place),
        base(s.where("label is null"), F.col("settled"), none, "graded", F.col("section"), place),
        base(own.where("source = 'grammar'"), F.col("risk"), F.col("category"), "grammar", none, F.col("event_id")),
        base(own.where("source = 'negatives'"), F.col("risk"), F.col("category"), "negatives", none, F.col("event_id")),
    ]


UNITED = [
    *SETTLED,
    "united as (select command, label::int as label, '' as category, 'seed' as source, section, '' as transform, (replace(path, 'list', '')::bigint * 2000 + line) as pos, 0 as priority from (select p.*, s.settled from parsed p join settled s using (path, line)) where label is not null"
    " union all select command, settled::int, '', 'graded', section, '', replace(path, 'list', '')::bigint * 2000 + line, 1 from (select p.*, s.settled from parsed p join settled s using (path, line)) where label is null"
    " union all select command, risk::int, category, 'grammar', '', '', event_id, 2 from log where source = 'grammar'"
    " union all select command, risk::int, category, 'negatives', '', '', event_id, 3 from log where source = 'negatives')",
    "corpus as (select * exclude (k) from (select *, row_number() over (partition by command, label order by priority, pos, category, source, section, transform) as k from united) where k = 1)",
]


def corpus(spark, sf_dir):
    return C.first_wins(C.united(parts(spark, sf_dir)), ["command", "label"], ["priority", "pos"])


@query(Q.with_ctes(UNITED, "select source, priority::int as priority, count(*) as n from united group by all"))
def b01_union_by_authority(spark, sf_dir):
    return C.united(parts(spark, sf_dir)).groupBy("source", "priority").agg(F.count("*").alias("n"))


@query(Q.with_ctes(UNITED, "select command, label, category, source, section, pos from corpus"))
def b02_first_wins(spark, sf_dir):
    return corpus(spark, sf_dir).select("command", "label", "category", "source", "section", "pos")


@query(Q.with_ctes(UNITED, "select command, count(distinct label) as n_labels from corpus group by 1 having count(distinct label) > 1"))
def b03_contradictions(spark, sf_dir):
    return C.contradictions(corpus(spark, sf_dir))


_PICK = "(('0x' || substr(sha256('{f}:' || command), 1, 8))::bigint % {n} + 1)"


def _pick(family: str, options: list[str]) -> str:
    return f"[{', '.join(options)}][{_PICK.format(f=family, n=len(options))}]"


def _long_flags(c: str) -> str:
    for flag, long in T.LONG_FLAGS:
        c = f"regexp_replace({c}, '^(|.*?\\s){flag}(\\s.*|)$', '\\1{long}\\2')"
    return c


_WORDS = "list_filter(regexp_split_to_array(command, '\\s+'), lambda w: w <> '')"
TRAIN_SQL = {
    "shell_wrapper": "case when contains(command, '\"') then 'sh -c ''' || command || '''' else " + _pick("shell_wrapper", ["'bash -c \"' || command || '\"'", "'sh -c ''' || command || ''''"]) + " end",
    "subshell": "'( ' || command || ' )'",
    "env_prefix": _pick("env_prefix", [f"'{e} ' || command" for e in T.ENVS]),
    "flag_longform": _long_flags("command"),
    "redirect_noise": _pick("redirect_noise", [f"command || ' {r}'" for r in T.REDIRECTS]),
    "segment_suffix": _pick("segment_suffix", [f"command || ' {s}'" for s in T.SUFFIXES]),
    "path_prefix": _pick("path_prefix", [f"'{p} ' || command" for p in T.PREFIXES]),
    "quote_split": "case when regexp_matches(command, '^[A-Za-z]\\S') then substr(command, 1, 1) || " + _pick("quote_split", ["''''''", "'\"\"'"]) + " || substr(command, 2) end",
    "comment_tail": _pick("comment_tail", [f"command || ' {c}'" for c in T.COMMENTS]),
    "line_continuation": "regexp_replace(command, '^(.*?\\s-\\w+)\\s(.*)$', '\\1 \\\\' || chr(10) || '   \\2')",
}
_SIZES = f"list_transform({_WORDS}, lambda w: length(w))"
_AT = f"list_position({_SIZES}, list_max({_SIZES}))"
_CUT = f"greatest(2, list_max({_SIZES}) // 2)"


def _escape_sql(one: str) -> str:
    first = f"{_WORDS}[1]"
    return f"case when regexp_matches({first}, '^[A-Za-z]\\S') then array_to_string(list_concat(['$''' || array_to_string(list_transform(string_split({first}, ''), lambda x: {one}), '') || ''''], {_WORDS}[2:]), ' ') end"


HOLDOUT_SQL = {
    "zero_width": f"case when list_max({_SIZES}) >= 3 then array_to_string(list_transform({_WORDS}, lambda w, i: case when i = {_AT} then substr(w, 1, {_CUT}) || chr(8203) || substr(w, {_CUT} + 1) else w end), ' ') end",
    "nbsp": "case when contains(command, ' ') then regexp_replace(regexp_replace(command, '^([^ ]*) (.*)$', '\\1' || chr(160) || '\\2'), '^([^ ]*) (.*)$', '\\1' || chr(160) || '\\2') end",
    "base64": "'echo ' || to_base64(encode(command)) || ' | base64 -d | sh'",
    "eval": "'eval \"$(echo ' || command || ')\"'",
    "hex_escape": _escape_sql("'\\x' || lpad(lower(hex(ascii(x))), 2, '0')"),
    "octal_escape": _escape_sql("'\\0' || (ascii(x) // 64)::varchar || ((ascii(x) // 8) % 8)::varchar || (ascii(x) % 8)::varchar"),
}


def _variants_sql(sql: dict[str, str], keys: str, table: str = "log") -> str:
    order = {f: i for i, f in enumerate(sql)}
    made = " union all ".join(f"select {keys}, command, '{f}' as family, {order[f]} as o, {e} as variant from {table}" for f, e in sql.items())
    return f"variants as (select * exclude (o, k) from (select *, row_number() over (partition by {keys}, variant order by o) as k from ({made}) where variant is not null and variant <> '' and variant <> command) where k = 1)"


@query(Q.with_ctes([*LOG, _variants_sql(TRAIN_SQL, "event_id")], "select event_id, family, variant from variants"))
def b04_train_variants(spark, sf_dir):
    return T.variants(log(spark, sf_dir), T.TRAIN).select("event_id", "family", "variant")


@query(Q.with_ctes([*LOG, _variants_sql(HOLDOUT_SQL, "event_id")], "select event_id, family, variant from variants"))
def b05_holdout_variants(spark, sf_dir):
    return T.variants(log(spark, sf_dir), T.HOLDOUT).select("event_id", "family", "variant")


@query(Q.with_ctes([*LOG, _variants_sql(HOLDOUT_SQL, "event_id, risk")], "select family, risk::int as risk, count(distinct variant) as n from variants group by 1, 2"))
def b06_holdout_distinct(spark, sf_dir):
    made = T.variants(log(spark, sf_dir), T.HOLDOUT).select("variant", "risk", "family", "event_id")
    return C.first_wins(made, ["variant", "risk", "family"], ["event_id"]).groupBy("family", "risk").agg(F.count("*").alias("n"))


@query(Q.with_ctes(UNITED, "select 'total' as kind, '' as key, -1::int as label, count(*) as n from corpus union all select 'unique', '', -1, count(distinct command) from corpus union all select 'label', '', label, count(*) from corpus group by label union all select 'source', source, -1, count(*) from corpus group by source union all select 'category', category, label, count(*) from corpus group by category, label union all select 'section', section, label, count(*) from corpus where section <> '' group by section, label"))
def b07_statistics(spark, sf_dir):
    return C.statistics(corpus(spark, sf_dir))


@query(SQL["b07_statistics"])
def s10_dataset_report(spark, sf_dir):
    """The corpus statistics as the report file has them."""
    path = Tab.shared_path(spark, "report")
    Tab.write_report(b07_statistics(spark, sf_dir), path)
    return spark.read.schema("kind string, key string, label int, n bigint").json(path)


@query(Q.with_ctes([*LOG, Q.audit_cte("log")], "select event_id, rule, display_only from audited"))
def b08_audit(spark, sf_dir):
    return A.audit(log(spark, sf_dir)).select("event_id", "rule", "display_only")


@query(Q.with_ctes([*LOG, Q.audit_cte("log")], "select 'total' as name, count(*) as n from audited union all select 'accepted', count(*) filter (rule is null) from audited union all select 'display_only', count(*) filter (display_only) from audited union all select 'echo_or_search', count(*) filter (regexp_matches(command, " + Q.lit(A.ECHO_OR_SEARCH) + ") and not regexp_matches(command, " + Q.lit(A.BARE_ECHO) + ")) from audited union all select 'rejected:' || rule, count(*) from audited where rule is not null group by rule"))
def b09_audit_statistics(spark, sf_dir):
    return A.statistics(A.audit(log(spark, sf_dir)))


@query(Q.with_ctes(UNITED, "select label, count(*) as n, round(100 * count(*)::double / sum(count(*)) over (), 4) as percent from corpus group by label"))
def b10_label_shares(spark, sf_dir):
    return C.shares(corpus(spark, sf_dir), "label")


@query(Q.with_ctes(UNITED, "select category, count(*) as n from corpus group by category order by n desc, category limit 22"))
def b10_top_categories(spark, sf_dir):
    return C.top_groups(corpus(spark, sf_dir), "category", 22)


_LEAKS = [
    *LOG,
    _variants_sql(HOLDOUT_SQL, "event_id"),
    Q.norm_cte("log", name="train"),
    "hold0 as (select event_id, family, replace(replace(variant, chr(8203), ''), chr(160), ' ') as v from variants)",
    Q.norm_cte("hold0", "v", name="hold"),
]


@query(Q.with_ctes(_LEAKS, "select family, count(*) as n, count(distinct event_id) as events from hold where text in (select text from train) group by 1"))
def b11_leaks(spark, sf_dir):
    """Holdout rows that normalise to a training row: invisible and no-break spaces always do."""
    held = T.variants(log(spark, sf_dir), T.HOLDOUT).select("event_id", "family", "variant")
    held = N.normalize_commands(held, "variant").select("event_id", "family", "text")
    return C.leaks(held, norm(spark, sf_dir)).groupBy("family").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("events"))


@query(Q.with_ctes([*LOG, _variants_sql({k: TRAIN_SQL[k] for k in ("subshell", "comment_tail")}, "event_id")], "select family, count(*) as n from variants group by 1"))
def b12_chosen_families(spark, sf_dir):
    return T.variants(log(spark, sf_dir), T.TRAIN, ["subshell", "comment_tail"]).groupBy("family").agg(F.count("*").alias("n"))
