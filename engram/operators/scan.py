"""The security scan of a memory's summary and details. One scan feeds the report and every gate.

Characters are decomposed and look-alikes become Latin letters; then the block patterns are searched in each field, in both fields
together, and (for credentials) in what base64 strings decode to. The result is an array column, so a gate reads its own row and nothing
is joined.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns that block a text (name, category, pattern); those marked (?i) ignore case.
BLOCK = (
    ("invisible_unicode_character", "invisible_unicode", "[\\u200B\\u200C\\u200D\\uFEFF\\u202A-\\u202E\\u2060\\u2066-\\u2069\\u00AD\\u200E\\u200F]"),
    ("ignore_previous_instructions", "prompt_injection", r"(?i)\b(?:ignore\s+previous\s+instructions|ignore\s+all\s+previous|disregard\s+your\s+rules)\b"),
    ("identity_override", "prompt_injection", r"(?i)\b(?:you\s+are\s+now|you\s+must\s+now|your\s+new\s+instructions)\b"),
    ("system_prompt_override", "prompt_injection", r"(?i)\b(?:system\s+prompt\s+override|override\s+system)\b"),
    ("concealment_instruction", "prompt_injection", r"(?i)\b(?:do\s+not\s+tell\s+the\s+user|hide\s+this\s+from|never\s+reveal)\b"),
    ("always_do_imperative", "prompt_injection", r"(?i)\balways\s+do\b[^\n\r]{0,60}\b(?:execute|run|reveal|ignore|obey|follow|share|disclose)\b"),
    ("from_now_on_always", "prompt_injection", r"(?i)\bfrom\s+now\s+on\s+always\b"),
    ("reveal_system_instructions", "prompt_injection", r"(?i)\breveal\s+your\b[^\n\r]{0,40}\b(?:instructions|system\s+prompt|rules)\b"),
    ("openai_api_key", "credential_pattern", r"\bsk-[a-zA-Z0-9]{20,}\b"),
    ("github_pat_classic", "credential_pattern", r"\bghp_[a-zA-Z0-9]{36}\b"),
    ("github_pat_fine_grained", "credential_pattern", r"\bgho_[a-zA-Z0-9]{36}\b"),
    ("aws_access_key", "credential_pattern", r"\bAKIA[A-Z0-9]{16}\b"),
    ("generic_password_assignment", "credential_pattern", r"(?i)\bpassword\s*[:=]\s*\S+"),
    ("generic_secret_assignment", "credential_pattern", r"(?i)\bsecret\s*[:=]\s*\S+"),
    ("generic_token_assignment", "credential_pattern", r"(?i)\btoken\s*[:=]\s*\S+"),
    ("bearer_token", "credential_pattern", r"\bBearer\s+[a-zA-Z0-9._\-]{20,}\b"),
    ("curl_credential_exfiltration", "malicious_instruction", r"(?i)\bcurl[^\n\r]*\$\{?[A-Z_]*KEY\b"),
    ("wget_credential_exfiltration", "malicious_instruction", r"(?i)\bwget[^\n\r]*\$\{?[A-Z_]*KEY\b"),
    ("sensitive_file_read", "malicious_instruction", r"(?i)\bcat\s+(?:\/etc\/shadow|~\/\.ssh|\.env|credentials)\b"),
    ("ssh_backdoor_authorized_keys", "malicious_instruction", r"(?i)\bauthorized_keys\b"),
    ("ssh_private_key_reference", "malicious_instruction", r"(?i)\bid_rsa\b"),
)
#: Look-alike characters and the Latin letters they stand for.
CONFUSABLE = ("аеорсухіјһԁａｅｉｏｕ", "aeopcyxijhdaeiou")
MAX_CONTENT, MAX_MATCH = 50_000, 100


#: A substring that every match of a pattern has, lower case if the pattern ignores case.
NEEDS = {
    "identity_override": "you", "system_prompt_override": "system", "always_do_imperative": "always", "from_now_on_always": "always", "reveal_system_instructions": "reveal", "generic_password_assignment": "password",
    "generic_secret_assignment": "secret", "generic_token_assignment": "token", "curl_credential_exfiltration": "curl", "wget_credential_exfiltration": "wget", "sensitive_file_read": "cat", "ssh_backdoor_authorized_keys": "authorized_keys",
    "ssh_private_key_reference": "id_rsa", "aws_access_key": "AKIA", "bearer_token": "Bearer", "openai_api_key": "sk-", "github_pat_classic": "ghp_", "github_pat_fine_grained": "gho_",
}


def cheap(text: Column, name: str, low: Column | None = None) -> Column:
    """A plain substring test that holds wherever the pattern ``name`` can match, so most texts never meet the pattern. ``low``: the text in lower case."""
    word = NEEDS.get(name)
    low = F.lower(text) if low is None else low
    return text.contains(word) if word and word != word.lower() else low.contains(word) if word else F.lit(True)


THREAT = "array<struct<name:string,category:string,match:string>>"
KEYS = tuple(x for x in BLOCK if x[1] == "credential_pattern")
#: Only the first letter of a run is tried.
CODE = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}"


def decomposed(text: Column) -> Column:
    """Compatibility decomposition, then look-alikes as Latin letters; null is empty. ASCII texts go to Python as nulls."""

    @F.pandas_udf("string")
    def nfkd(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFKD", x), na_action="ignore")

    return F.translate(F.coalesce(nfkd(F.when(F.octet_length(text) != F.char_length(text), text)), text, F.lit("")), *CONFUSABLE)


def decoded(code: Column) -> Column:
    """The text of a base64 string, read leniently: a rest of one character is dropped, padding is filled up, bytes that are no UTF-8 become U+FFFD."""
    bare = F.rtrim(code, F.lit("="))
    rest = F.length(bare) % 4
    full = F.when(rest == 1, F.left(bare, F.length(bare) - 1)).when(rest == 0, bare).otherwise(F.concat(bare, F.repeat(F.lit("="), 4 - rest)))
    return F.make_valid_utf8(F.try_to_binary(full, F.lit("base64")).cast("string"))


def _hits(text: Column, low: Column, where: str, some: tuple = BLOCK, prefix: str = "") -> Column:
    """All matches of the patterns ``some`` in ``text``, in their order, each with where it was found, cut to ``MAX_MATCH`` characters."""

    def part(name: str, category: str, p: str) -> Column:
        row = lambda m: F.struct(F.lit(prefix + name).alias("name"), F.lit(category).alias("category"), F.substring(F.concat(F.lit(where), m), 1, MAX_MATCH).alias("match"))
        return F.coalesce(F.when(cheap(text, name, low), F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), row)), F.from_json(F.lit("[]"), THREAT))

    return F.flatten(F.array(*(part(*x) for x in some)))


def scanned(rows: DataFrame) -> DataFrame:
    """``rows`` (summary, details and others) with ``threats``: an array of (name, category, match), empty if the memory is safe.

    A pattern that only matches across both fields counts once; base64 counts for credentials only. Null fields are empty.
    """
    held = rows.select("*", decomposed(F.col("summary")).alias("_summary"), decomposed(F.col("details")).alias("_details"))
    # Lower-case texts are columns of their own, or they would be made again for each pattern.
    held = held.withColumn("_both", F.concat_ws(" ", "_summary", "_details"))
    held = held.withColumn("_both low", F.lower("_both"))
    # No pattern is anchored, so what matches in a field matches in both together: one look there decides whether the texts are searched at all.
    some = reduce(Column.__or__, (cheap(F.col("_both"), name, F.col("_both low")) & F.col("_both").rlike(p) for name, _, p in BLOCK))
    held = held.withColumn("_some", some)
    # Strings of base64 don't cross the blank between the fields.
    held = held.withColumn("_codes", F.regexp_extract_all("_both", F.lit(CODE), F.lit(0)))
    held = held.select(*rows.columns, "_codes", *(F.when(F.col("_some"), F.col(c)).alias(c) for c in ("_summary", "_details", "_both", "_both low")))
    # Lower-case texts are columns of their own, or they would be made again for each pattern.
    held = held.select("*", *(F.lower(c).alias(f"{c} low") for c in ("_summary", "_details")))
    hits = lambda c, where: _hits(F.col(c), F.col(f"{c} low"), where)
    own = F.concat(hits("_summary", "summary: "), hits("_details", "details: "))
    held = held.select("*", own.alias("_own"), hits("_both", "cross-field: summary: ").alias("_joint"), F.transform("_codes", decoded).alias("_plain"))
    known = lambda x: F.exists("_own", lambda y: (y["name"] == x["name"]) & (y["category"] == x["category"]))
    held = held.withColumn("_cross", F.filter("_joint", lambda x: ~known(x)))
    # Of several cross-field matches of a pattern the first counts.
    names = F.array_distinct(F.transform("_cross", lambda x: x["name"]))
    first = F.transform(names, lambda n: F.get(F.filter("_cross", lambda x: x["name"] == n), F.lit(0)))
    hidden = F.flatten(F.transform(F.filter("_plain", lambda x: x.isNotNull()), lambda x: _hits(x, F.lower(x), "base64-decoded: details: ", KEYS, "base64_encoded_")))
    return held.withColumn("threats", F.concat("_own", first, hidden)).drop("_summary", "_details", "_codes", "_own", "_both", "_joint", "_plain", "_cross", "_summary low", "_details low", "_both low")


def with_safety(rows: DataFrame) -> DataFrame:
    """``rows`` with ``safe``: whether the scan finds nothing that blocks."""
    return scanned(rows).withColumn("safe", F.size("threats") == 0).drop("threats")


def threats(rows: DataFrame) -> DataFrame:
    """(id, name, category, match) of the whole scan, a row for each threat."""
    # With explode() Spark would ask for the array's size below the scan, and so scan twice.
    return scanned(rows.select("id", "summary", "details")).select("id", F.explode_outer("threats").alias("t")).where("t is not null").select("id", "t.*")


def _may_repeat(text: Column) -> Column:
    """Whether ``text`` can hold ten copies in a row of 20 to 100 characters: false for nearly all texts that don't.

    The copies take 200 characters or more, so a multiple of 100 lies in the first half of them, and the 20 characters from there come again
    within 100 characters. Each text is cut once, at these multiples.
    """
    pieces = F.array(F.regexp_extract_all(text, F.lit("(?s).{1,100}"), F.lit(0)))
    after = lambda p, x, i: F.concat(F.substring(x, 2, 99), F.left(F.coalesce(F.get(p, i + 1), F.lit("")), F.lit(20)))
    return F.exists(pieces, lambda p: F.exists(F.transform(p, lambda x, i: F.contains(after(p, x, i), F.left(x, F.lit(20)))), lambda again: again))


def warnings(text: Column) -> Column:
    """Names of warnings: over-long, mostly non-printable, or repetitive content."""
    n = F.length(text)
    odd = F.regexp_count(text, F.lit("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"))
    return F.array_compact(F.array(
        F.when(n > MAX_CONTENT, F.lit("content_length")), F.when((n > 0) & (odd * 2 > n), F.lit("non_printable")), F.when(_may_repeat(text) & text.rlike(r"(?s)(.{20,100}?)\1{9,}"), F.lit("repetitive"))
    ))
