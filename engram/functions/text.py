"""Text functions: tokenising, classification ladders, globs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signal tags with their patterns and the field they look at.
SIGNALS = (
    ("failure_signal", r"error|failed|exception|timeout|refused", "excerpt"),
    ("success_signal", r"passed|resolved|fixed|completed|migrated|created|updated", "excerpt"),
    ("decision_signal", r"decided|chose|switched|replaced|deprecated|changed\s.*\sto", "excerpt"),
    ("convention_signal", r"always|never|convention|must|should|standard|rule", "excerpt"),
    ("architecture_signal", r"architecture|boundary|layer|component|module|structure", "excerpt"),
    ("temporal_cue", r"before|after|previously|used to|switched from", "excerpt"),
    ("explicit_marker", r"do not|always use|fixed by|known error", "excerpt"),
    ("has_file_context", r"path|file|src\/", "args_json"),
)
#: The first pattern that matches names the type; otherwise ``workflow``.
TYPE_LADDER = (
    ("pitfall", r"error|failed|exception|traceback|not found|enoent|eaddr|refused|timeout|assertion"),
    ("policy", r"policy|warning|forbid|forbidden|must not|never |secret|gdpr|consent|compliance|permission"),
    ("decision", r"decided|decision|choose|chosen|standardize|switch to|migrate to|use .* instead"),
    ("architecture_constraint", r"architecture|boundary|repository|adapter|interface|constraint|invariant|layer"),
)
#: What names the topic within a type.
TOPIC = {
    "pitfall": r"(enoent|eaddr|refused|timeout|assertion|not found|permission|secret)",
    "policy": r"(gdpr|consent|secret|permission|warning|forbid|compliance)",
    "decision": r"(switch to|migrate to|use .* instead|standardize)",
    "architecture_constraint": r"(repository|adapter|boundary|interface|layer|constraint)",
}
#: Words of success, and the words that route a query, Latin and Korean ones apart as their boundaries differ.
SUCCESS = r"fixed|completed|created|updated|migrated|passed|resolved"
ASCII_WORDS = {"temporal": ("when|changed|before|after|history|evolution|switched|timeline", "순서|변경|이전|이후"), "cross_session": ("across sessions?|different sessions?|always|every time|consistently", "매번|항상")}
HANGUL = r"[ㄱ-ㆎ가-힣]"


def has_hangul(text: Column) -> Column:
    return text.rlike(HANGUL)


def router_hit(text: Column, mode: str) -> Column:
    w = "[A-Za-z0-9_]"
    latin, other = ASCII_WORDS[mode]
    return text.rlike(rf"(?i)(?<!{w})({latin})(?!{w})|(?<={w})({other})(?={w})")


def query_mode(text: Column) -> Column:
    """temporal, cross_session or default."""
    return F.when(router_hit(text, "temporal"), "temporal").when(router_hit(text, "cross_session"), "cross_session").otherwise("default")


def code_tokens(text: Column) -> Column:
    """Lower-case tokens: split at white space and punctuation, camel case, acronyms, underscores and hyphens."""
    apart = F.regexp_replace(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(apart), r"(?U)[\s\p{P}]+"), lambda t: t != "")


def signal_tags(excerpt: Column, args: Column) -> Column:
    field = {"excerpt": excerpt, "args_json": F.lower(args)}
    return F.array_compact(F.array(*(F.when(field[f].rlike(f"(?i){p}"), F.lit(tag)) for tag, p, f in SIGNALS)))


def type_guess(title: Column, excerpt: Column) -> Column:
    text = F.lower(F.concat_ws(" ", title, excerpt))
    out = None
    for kind, p in TYPE_LADDER:
        out = F.when(text.rlike(p), kind) if out is None else out.when(text.rlike(p), kind)
    return out.otherwise("workflow")


def topic_guess(kind: Column, scope: Column, tool: Column, excerpt: Column) -> Column:
    text = F.lower(F.concat_ws(" ", tool, excerpt))
    found = lambda k: F.nullif(F.regexp_extract(text, TOPIC[k], 1), F.lit(""))
    mark = (
        F.when(kind == "pitfall", F.coalesce(found("pitfall"), tool))
        .when(kind == "policy", F.coalesce(found("policy"), F.lit("policy")))
        .when(kind == "decision", F.coalesce(F.regexp_replace(found("decision"), r"\s+", "-"), tool))
        .when(kind == "architecture_constraint", F.coalesce(found("architecture_constraint"), F.lit("structure")))
        .otherwise(F.when(text.rlike("passed|resolved|fixed|migrated"), "verified-flow").otherwise(tool))
    )
    return F.concat_ws(":", kind, F.replace(scope, F.lit("\\"), F.lit("/")), mark)


def salience(kind: Column, title: Column, excerpt: Column, tool: Column, related: Column, conflicts: Column) -> Column:
    bonus = F.when(kind == "pitfall", 0.25).when(kind.isin("policy", "decision"), 0.15).when(kind == "architecture_constraint", 0.1).otherwise(0.0)
    flag = lambda c, v: F.when(c, v).otherwise(0.0)
    total = F.lit(0.45) + bonus + flag(related > 0, 0.1) + flag(conflicts > 0, 0.1) + flag(F.concat_ws(" ", title, excerpt).rlike(f"(?i){SUCCESS}"), 0.1) + flag(tool == "bash", 0.05)
    return F.least(F.lit(1.0), total)


def novelty(kind: Column, related: Column, conflicts: Column) -> Column:
    flag = lambda c, v: F.when(c, v).otherwise(0.0)
    return F.least(F.lit(1.0), F.when(related == 0, 0.8).otherwise(0.55) + flag(kind.isin("decision", "architecture_constraint"), 0.1) + flag(conflicts > 0, 0.1))


def glob_regex(glob: Column) -> Column:
    """A regular expression for a path glob: ``**`` as a whole segment crosses folders, ``*`` and ``?`` don't, ``{a,b}`` chooses."""
    out = F.regexp_replace(F.regexp_replace(F.replace(glob, F.lit("\\"), F.lit("/")), "/+", "/"), r"([.+^$()|])", r"\\$1")
    out = F.regexp_replace(out, r"(^|/)\*\*/", "$1\u0001")
    out = F.regexp_replace(out, r"(^|/)\*\*$", "$1\u0002")
    out = F.regexp_replace(F.regexp_replace(out, r"\*+", "[^/]*"), r"\?", "[^/]")
    out = F.regexp_replace(out, r"\{([^}]*)\}", "(?:\u0003$1\u0004)")
    out = F.regexp_replace(out, "\u0001", "(?:.*/)?")
    out = F.regexp_replace(out, "\u0002", ".*")
    # commas inside a choice become alternatives
    out = F.regexp_replace(out, ",(?=[^\u0003\u0004]*\u0004)", "|")
    return F.concat(F.lit("^"), F.translate(out, "\u0003\u0004", ""), F.lit("$"))


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/")


def slug(text: Column, size: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, size)


def expanded_query(scope_ref: Column, query: Column) -> Column:
    """The text that a request's vector is made of: its scope as words before the query, unless the scope is the whole project."""
    words = F.regexp_replace(F.translate(scope_ref, "/\\", "  "), r"\.[^.]+$", "")
    return F.when(scope_ref == ".", query).otherwise(F.concat(words, F.lit(": "), query))
