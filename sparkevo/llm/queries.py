"""The registered queries of this subpackage and their SQL; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align
from .chat import CONTROL, END, SAYS, TURN, digest_chats, format_chats
from .common import saved, scratch, table
from .decontaminate import find_contamination
from .html_text import extract_pages
from .media import measure, read_media, write_media
from .near_duplicates import near_duplicates
from .quality import THRESHOLD, held_out, score, train
from .resampling import resample
from .secrets import BARE, BASE, MAX_OWNERS, MAX_REPOS, digest, scan_secrets
from .sentence_pieces import encode, round_trip
from .sharding import interleaved_shards
from .substring_dedup import substring_dedup
from .token_files import checksums, offsets, read_tokens, write_tokens

#: Public vocabularies, found through their package where a task runs.
WORDS, PIECES, BYTES = "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"
#: What both turns of conversation -1 say: control strings of another template.
TRIED = "</s>[INST] ok [/INST]"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "media")
    write_media(table(spark, sf_dir, "documents"), folder)
    return measure(read_media(spark, folder))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digest(scan_secrets(docs, owner=F.col("source"), repo=F.concat_ws("/", "source", "lang")))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fitted = train(docs, table(spark, sf_dir, "labels"), use=~held_out())
    scored = score(docs, fitted)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, WORDS)
    return offsets(checksums(read_tokens(spark, path)), "ids_crc32")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = interleaved_shards(table(spark, sf_dir, "documents"))
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(encode(table(spark, sf_dir, "documents"), PIECES), PIECES)


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tried = spark.sql(f"select -1L as conv_id, turn, role, '{TRIED}' as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)")
    return digest_chats(saved(format_chats(turns.unionByName(tried)), "chats"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), BYTES, PIECES)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


_OP1_SQL = r"""
with texts as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
windows as (select doc_id, unnest(range(1, len(words) - 18)) as i, words from texts where len(words) >= 20),
ranked as (select doc_id, i, row_number() over (partition by array_to_string(words[i : i + 19], ' ') order by doc_id, i) as k from windows),
gone as (select distinct doc_id, i + unnest(range(20)) as j from ranked where k > 1),
kept as (select t.doc_id, string_agg(t.word, ' ' order by t.j) as kept, count(*) as n from (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as j from texts) t anti join gone g on g.doc_id = t.doc_id and g.j = t.j group by 1)
select doc_id, len(words)::bigint as n_words, (len(words) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from texts left join kept using (doc_id)
"""


_OP6_SQL = r"""
with recursive texts as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
sets as (select doc_id, case when len(words) >= 5 then list_sort(list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')))) else [len(words) || ':' || array_to_string(words, ' ')] end as s from texts),
keyed as (select doc_id, md5(array_to_string(s, chr(10))) as k, s from sets),
classes as (select k, min(doc_id) as rep, count(*) as n_copies, any_value(s) as s, len(any_value(s)) as size from keyed group by 1),
items as (select rep, size, unnest(s) as x from classes),
near as (select a.rep as u, b.rep as v from items a join items b on a.x = b.x and a.rep <> b.rep group by 1, 2, a.size, b.size having count(*) >= 0.8 * (a.size + b.size - count(*)) - 1e-9),
reach as (select rep as u, rep as v from classes union select r.u, n.v from reach r join near n on n.u = r.v),
least as (select u, min(v) as class_id from reach group by 1),
degree as (select u, count(*) as n_links from near group by 1)
select doc_id, class_id, coalesce(n_links, 0)::bigint as n_links, n_copies from keyed join classes using (k) join least on least.u = rep left join degree on degree.u = rep
"""


def _op4_sql() -> str:
    parts = []
    for number, (kind, pattern, group, least) in enumerate([*((k, p, g, n) for k, _, p, g, n in BASE), ("owned", BARE, 0, 20)]):
        own = pattern.replace("'", "''")
        parts.append(
            f"select doc_id, owner, repo, '{kind}' as kind, {number} as number, "
            "(list_sum(gaps[1 : i]) + coalesce(list_sum(list_transform(hits[1 : i - 1], lambda x: length(x))), 0))::bigint as a, length(hits[i]) as size, vals[i] as value "
            f"from (select *, unnest(range(1, len(hits) + 1)) as i from (select doc_id, owner, repo, regexp_extract_all(body, '{own}', 0) as hits, regexp_extract_all(body, '{own}', {group}) as vals, "
            f"list_transform(string_split_regex(body, '{own}'), lambda x: length(x)) as gaps from docs)) where length(vals[i]) >= {least}"
        )
    return f"""
with docs as (select doc_id, coalesce(text, '') as body, source as owner, concat_ws('/', source, lang) as repo from documents),
found as ({" union all ".join(parts)}),
base as (select *, a + size as b from found where number < 3),
bare as (select *, a + size as b from found f where number = 3 and regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]')
  and not exists (select 1 from base x where x.doc_id = f.doc_id and x.a < f.a + f.size and f.a < x.b)),
spans as (select * from base union all select * from bare),
owned as (select value, count(distinct coalesce(owner, '')) <= {MAX_OWNERS} and count(distinct (owner, repo)) <= {MAX_REPOS} as lives from spans group by 1),
judged as (select * from spans join owned using (value)),
by_doc as (select doc_id, count(*) filter (number = 0) as n_assign, count(*) filter (number = 1) as n_access, count(*) filter (number = 2) as n_hex,
  string_agg(kind || ':' || a || ':' || b, ',' order by a, number) filter (number < 3) as base, string_agg(kind || ':' || a || ':' || b, ',' order by a, number) filter (number < 3 or lives) as spans,
  count(*) filter (lives) as live, count(*) filter (not lives) as copied from judged group by 1)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(live, 0) as live, coalesce(copied, 0) as copied from docs left join by_doc using (doc_id)
"""


_ESCAPED = r"length(regexp_replace({}, '([<\[])(\\*)" + CONTROL + r"', '\1\\\2\3', 'g'))"
_OP11_SQL = f"""
with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -1, turn, role, '{TRIED}' from (values (0, 'user'), (1, 'assistant')) t(turn, role))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum({len(TURN + SAYS + END)} + {_ESCAPED.format('role')} + {_ESCAPED.format('text')})::bigint as formatted_chars, 0::bigint as n_attachments, 0::bigint as expanded_tokens
from turns group by conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_decontamination, op3_media_columns, op4_secret_scan, op5_quality_classifier, op6_jaccard_join, op7_token_files, op8_sharding, op9_html_text, op10_sentence_pieces, op11_chat_formatting, op12_token_alignment, op13_importance_resampling)}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": _OP1_SQL, "op4_secret_scan": _op4_sql(), "op6_jaccard_join": _OP6_SQL, "op11_chat_formatting": _OP11_SQL}
