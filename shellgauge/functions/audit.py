"""Whether a command only mentions something dangerous or would run it."""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules in order; the first that matches is reported. RAW ones read the command with its
# quotes, the others without quoted spans and print() bodies.
RULES = (
    ("pipe_to_interpreter", r"\|\s*(?:sudo\s+)?(?:ba|z|k|da)?sh\b|\|\s*(?:sudo\s+)?(?:python3?|perl|ruby|node|php)\b|\|\s*(?:sudo\s+)?(?:xargs|tee)\s+\S*\s*(?:rm|dd|mkfs|shutdown)\b"),
    ("eval", r"(?:^|[\s;&|(])eval\b"),
    ("command_substitution_execution", r"\$\(|\$\{"),
    ("xargs", r"(?:^|[\s;&|(])xargs\b"),
    ("find_exec", r"-exec\s+(?:rm|dd|mkfs|chmod|sh)\b"),
    ("watch_exec", r"(?:^|[\s;&|(])watch\b[^;|&]*\b(?:rm|dd|mkfs|chmod|chown)\b"),
    ("loop_execution", r"\b(?:for|while)\b[^;|&]*\bdo\b[^;|&]*\b(?:rm|dd|mkfs|chmod|shutdown)\b"),
    ("shell_wrapper_execution", r"(?:^|[\s;&|(])(?:bash|sh|zsh)\s+-[cl]\s|(?:^|[\s;&|(])(?:python3?|perl|ruby|node)\s+-[cl]\s[^\n]*?\b(?:exec|eval|system|popen|spawn|child_process|require)\b"),
    ("unexpanded_destructive_variable", r"\b(?:rm|dd|mkfs|mke2fs|chown|shred)\b[^;|&]*(?:\$\{?[A-Za-z_][A-Za-z0-9_]*\}?|\$1|\$\*)"),
    (
        "redirect_into_system_path",
        r"(?:^|[\s;&|(])(?:>|>>|tee\b|install\s+-m\S*|cp\b|mv\b)\s*[\"']?(?:/etc/|/usr/|/var/|/bin/|/sbin/|/boot/|/lib/|/root/|/home/|/sdcard|/storage/|/data/data|/proc/|/sys/)"
        r"|\bdd\b[^;|&]*\bof=\s*[\"']?/dev/(?!null|zero|random|urandom|stderr|stdout)[a-z]",
    ),
)
RAW = ("watch_exec", "shell_wrapper_execution")
DISPLAY = r"^\s*(?:echo|printf|grep|rg|ag|ack|man|info|whatis|apropos|cat|head|tail|wc|sort|uniq|less|more|nl|tac)\b"
PIPE_OUT = r"\|\s*\S"
REDIRECT_OUT = r"(?:^|\s)\d?>>?\s*/(?:etc|usr|var|bin|sbin|boot|lib|root|home|sdcard|storage|data|proc|sys)/"
QUOTED = r"'[^']*'|\"[^\"]*\""
PRINT = r"\b(?:print[lf]?|console\.log)\s*\("
# Verbs that print or search, and those that print nothing but an open quote.
ECHO_OR_SEARCH, BARE_ECHO = r"^\s*(?:echo|printf|grep|rg|ag|ack)\b", r"(?:^|[\s;&|(])(?:echo|printf)\s+[\"']?$"
#: Stands for the head of a print call in marked text; brackets and what is between them, as tokens.
MARK = "\x01"
TOKENS = f"[{MARK}()\\[\\]{{}}]|[^{MARK}()\\[\\]{{}}]+"


def without_prints(command: Column) -> Column:
    """The command without its print() calls, however deep brackets of any kind nest in them; one that is never closed goes up to the end.

    Bracket depth is a running sum over the command's tokens, within the row; only commands that print are cut up."""
    marked = F.regexp_replace(F.translate(command, MARK, ""), PRINT, MARK)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"))
    opens, closes = F.lit(f"{MARK}([{{"), F.lit(")]}")

    def step(state: Column, token: Column) -> Column:
        inside = state["depth"] > 0
        out = F.when(inside | (token == MARK), state["out"]).otherwise(F.concat(state["out"], token))
        depth = F.when(inside | (token == MARK), state["depth"] + F.when(F.instr(opens, token) > 0, 1).when(F.instr(closes, token) > 0, -1).otherwise(0)).otherwise(0)
        return F.struct(out.alias("out"), depth.alias("depth"))

    cut = F.aggregate(F.regexp_extract_all(marked, F.lit(TOKENS), F.lit(0)), start, step, lambda state: state["out"])
    return F.when(command.rlike(PRINT), cut).otherwise(command)


def inert(command: Column) -> Column:
    """The command without print() calls and quoted spans."""
    return F.regexp_replace(without_prints(command), QUOTED, " ")


def shows_only(command: Column) -> Column:
    """Starts with a verb that displays or searches, and neither pipes nor writes into a system path."""
    return command.rlike(DISPLAY) & ~command.rlike(PIPE_OUT) & ~command.rlike(REDIRECT_OUT)


def fired_rule(command: Column, plain: Column) -> Column:
    """Name of the first rule that fires; null if none. plain: inert(command)."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(RULES):
        out = F.when((command if name in RAW else plain).rlike(pattern), name).otherwise(out)
    return F.when(~shows_only(command), out)


def audit(df: DataFrame, command: str = "command") -> DataFrame:
    """Adds rule (null: accepted) and display_only."""
    out = df.withColumn("plain_", inert(F.col(command)))
    return out.withColumn("rule", fired_rule(F.col(command), F.col("plain_"))).withColumn("display_only", shows_only(F.col(command))).drop("plain_")


def statistics(audited: DataFrame, command: str = "command") -> DataFrame:
    """name, n: total, accepted, display_only, echo_or_search, and rejected:<rule> of each rule that fired."""
    echo = ~F.col(command).rlike(BARE_ECHO) & F.col(command).rlike(ECHO_OR_SEARCH)
    one = audited.agg(F.count("*").alias("total"), F.count_if(F.col("rule").isNull()).alias("accepted"), F.count_if("display_only").alias("display_only"), F.count_if(echo).alias("echo_or_search"))
    counts = one.unpivot([], ["total", "accepted", "display_only", "echo_or_search"], "name", "n")
    rejected = audited.where("rule is not null").groupBy("rule").agg(F.count("*").alias("n"))
    return counts.unionByName(rejected.select(F.concat(F.lit("rejected:"), "rule").alias("name"), "n"))


class Rejected(ValueError):
    pass


def gated(df: DataFrame, command: str = "command") -> DataFrame:
    """The rows, audited by whatever job reads them: the first row that a rule rejects ends the job with an error that names it."""
    plain = inert(F.col(command))
    rule = fired_rule(F.col(command), plain)
    passes = F.when(rule.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("rejected by "), rule, F.lit(": "), F.col(command))))
    return df.where(passes)


def write_gated(df: DataFrame, path: str, command: str = "command") -> None:
    """Writes the rows as Parquet in the job that audits them. If a row is rejected, that job fails before it commits, so nothing
    is left at the path; Rejected says which rule and command."""
    try:
        gated(df, command).write.parquet(path)
    except PySparkException as e:
        found = re.search(r"rejected by \w+: [^\n]*", str(e))
        if found is None:
            raise
        context = df.sparkSession.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
        raise Rejected(found[0]) from None
