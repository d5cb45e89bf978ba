"""Queries of this subpackage for the entry point, and the SQL of those that SQL can express."""

from __future__ import annotations

from .imatch import op5_imatch
from .interaction import OP13_SQL, op13_interaction
from .jpeg import op9_jpeg_media
from .linededup import OP10_SQL, op10_line_dedup
from .mixing import op6_mixing
from .packing import op1_packing
from .pii import op7_pii
from .ppm import op4_ppm
from .quality import op8_quality
from .recompression import op2_recompression
from .resample import OP12_SQL, op12_resampling
from .rules import OP11_SQL, op11_quality_rules
from .simhash import op3_simhash

QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_recompression, op3_simhash, op4_ppm, op5_imatch, op6_mixing, op7_pii, op8_quality, op9_jpeg_media, op10_line_dedup,
        op11_quality_rules, op12_resampling, op13_interaction,
    )
}

ORACLE_SQL = {
    "op10_line_dedup": OP10_SQL,
    "op11_quality_rules": OP11_SQL,
    "op12_resampling": OP12_SQL,
    "op13_interaction": OP13_SQL,
    "op2_recompression": r"""
with w as (
    select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents
), win as (
    select doc_id, unnest(range(1, len(words) - 33)) as start, words from w where len(words) >= 35
), named as (select doc_id, start, sha256(array_to_string(words[start : start + 34], ' ')) as name from win),
twice as (select name from named group by name having count(*) > 1),
hit as (select doc_id, start from named semi join twice using (name)),
gone as (select doc_id, list(distinct p) as places from (select doc_id, unnest(range(start, start + 35)) as p from hit) group by doc_id),
kept as (
    select w.doc_id, len(words) as n_words, coalesce(len(places), 0) as n_removed,
        case when places is null then words else list_select(words, list_filter(range(1, len(words) + 1), lambda i: not list_contains(places, i))) end as left_words
    from w left join gone using (doc_id)
)
select doc_id, n_words, n_removed, sha256(array_to_string(left_words, ' ')) as kept_sha256 from kept
""",
}
