"""Weak labels from ordered rules over the lower-cased raw command."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The grader's patterns and lists, in the order in which they are tried. Those with a
# capital can't match a lower-cased command and are left out.
PIPE_TO_SHELL = r"(?:curl|wget|fetch)[^;|&]*\|\s*(?:sudo\s+)?(?:ba|z|k|da)?sh\b|\|\s*(?:sudo\s+)?(?:ba|z|k|da)?sh\b|\|\s*(?:sudo\s+)?(?:python3?|perl|ruby|node|php)\b"
DESTRUCTIVE = (
    "mkfs", "mke2fs", "mkswap", "wipefs", "fdisk", "parted", "sgdisk", "gparted", "dd if=", "shutdown -h", "shutdown -r", "reboot", "poweroff", "halt",
    "init 0", "init 6", ":(){", ":(){:", "chmod 777", "chmod a+rwx", "chmod 666", "authorized_keys", "nc -e", "ncat -e", "socat", "base64 -d |", "base64 --decode |", 'eval "$(echo',
)
RISKY = (
    "rm -rf", "rm -fr", "rm -r ", "kill -9", "killall", "pkill", "docker system prune", "docker image prune -a", "docker volume prune", "docker rm -f",
    "apt-get remove", "apt-get autoremove", "apt purge", "yum remove", "dnf remove", "git reset --hard", "git clean -f", "git push --force", "git push -f",
    "git checkout .", "git restore .", "git filter-branch", "git reflog expire", "kubectl delete", "truncate -s", "systemctl restart", "systemctl stop", "rm -f",
    "flush --noinput", "migrate reset", "db:reset", "force-reset", "--force-reset", "pip uninstall", "npm uninstall -g", "gem uninstall",
)
DISPOSABLE = (
    "node_modules", "build/", "dist/", "target/", ".gradle", ".venv", "venv/", "__pycache__", ".pytest_cache", ".mypy_cache", ".next", ".nuxt", ".cache", "vendor/", "pods/",
    "deriveddata", ".terraform", "coverage", ".tox", ".parcel-cache", ".turbo", "*.o", "*.class", "*.pyc", ".ds_store", "*.log", "*.tmp", "*.bak", "*~", ".cache/", "cmakecachefiles",
)
RECURSIVE = ("rm -rf", "rm -fr", "rm -r")
BLOCK_DEVICE = r"/dev/(?:sd[a-z]|nvme\d|mmcblk|hd[a-z])"
WILDCARD = r"(?:^|[\s])\*(?:\.\*)?(?:\*)?(?:/|$)"
SYSTEM_PATH = r"(?:^|[\s;&|(])(/(?:etc|usr|var|bin|sbin|boot|lib|opt|srv|root|home|sys|proc|dev|sdcard|storage|data)(?:/|\b)|\s~/?\s|\$\(pwd\))"
RELATIVE_END = ("/src", "/target", "src")
PLAIN_WILDCARD = r"(?:^|\s)rm(?:\s+-\w+)*\s+\*"
MUTATING = ("rm", "chmod", "chown", "dd", "mv", "cp")

#: What a section says about its unlabelled lines.
SECTION_DEFAULT = {"routine": 0, "looks_scary": 0, "accident": 1, "feared": 1}


def _any(c: Column, tokens: tuple[str, ...]) -> Column:
    """Whether the command contains one of the tokens; one pattern keeps the generated code small."""
    return c.rlike("|".join(re.escape(t) for t in tokens))


def _first(c: Column, tokens: tuple[str, ...]) -> Column:
    """The first token of the list that the command contains; evaluated only where there is one."""
    return F.trim(F.element_at(F.filter(F.array(*map(F.lit, tokens)), lambda t: c.contains(t)), 1))


def rule(command: Column) -> Column:
    """Name of the first rule that fires; null for a null command."""
    c = F.lower(command)
    relative = r"\./|(?:/src|/target|src)\s*$"
    delete = (
        F.when(_any(c, DISPOSABLE), "delete_disposable_target")
        .when(c.rlike(BLOCK_DEVICE), "delete_block_device")
        .when(c.rlike(WILDCARD), "delete_wildcard")
        .when(c.rlike(SYSTEM_PATH), "delete_system_path")
        .when(c.rlike(relative), "delete_relative_path")
        .otherwise("delete_unknown_target")
    )
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(c.rlike(PIPE_TO_SHELL), "pipe_to_shell")
        .when(_any(c, DESTRUCTIVE), F.concat(F.lit("destructive_verb:"), _first(c, DESTRUCTIVE)))
        .when(_any(c, RECURSIVE), delete)
        .when(c.rlike(PLAIN_WILDCARD), "delete_wildcard_no_recursive")
        .when(_any(c, RISKY), F.concat(F.lit("risky_verb:"), _first(c, RISKY)))
        .when(c.rlike(SYSTEM_PATH) & _any(c, MUTATING), "touches_system_path")
        .otherwise("default_safe")
    )


def risk_of_rule(name: Column) -> Column:
    """The risk that goes with a rule."""
    two = name.isin("pipe_to_shell", "delete_block_device", "delete_wildcard", "delete_system_path", "delete_wildcard_no_recursive") | name.startswith("destructive_verb:")
    none = name.isin("default_safe", "delete_disposable_target")
    return F.when(two, 2).when(none, 0).when(name.isNotNull(), 1)


def graded(df: DataFrame, command: str = "command") -> DataFrame:
    """Adds rule and graded (its risk)."""
    return df.withColumn("rule", rule(F.col(command))).withColumn("graded", risk_of_rule(F.col("rule")))


def settled_label(label: Column, section: Column, graded_risk: Column) -> Column:
    """The author's label, else the section's, else the grader's."""
    default = F.coalesce(*[F.when(section == s, r) for s, r in SECTION_DEFAULT.items()])
    return F.coalesce(label, default, graded_risk)
