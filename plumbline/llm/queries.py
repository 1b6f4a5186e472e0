"""The named queries of this subpackage, one for each operator."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, chat, chunk_bpe, collocations, decontaminate, merkle, near_dup, pii, quality, token_counts, toxicity, unit_dedup, warc
from plumbline.llm.common import read_table
from plumbline.llm.registry import query
from plumbline.session import cut_lineage, scratch_path

WORD = r"[^\x20\x09-\x0D]+"


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = toxicity.grade(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return graded.select("doc_id", "toxic", "grade", F.round("severity", 6).alias("severity"), F.round(F.col("at_least")[0], 6).alias("p_toxic"))


@query("op2_pii")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    count = lambda k: F.expr(f"cast(size(filter(spans, s -> s.base and s.kind = '{k}')) as bigint)").alias(f"n_{k}")
    return found.select(
        "row.doc_id",
        *map(count, pii.KINDS),
        F.sha2(F.expr(joined.format("filter(spans, s -> s.base)")), 256).alias("base_sha256"),
        F.expr(joined.format("spans")).alias("spans"),
    )


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(read_table(spark, sf_dir, "documents"), bpe.rank_file("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), "n_pretokens", "n_misses")


@query("op4_near_dup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(read_table(spark, sf_dir, "documents"), threshold=Fraction(85, 100))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op5_chat_format")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(read_table(spark, sf_dir, "conversations"))


OP6_SQL = f"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '{WORD}') as words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as lines from t),
tri as (select doc_id, i, count(*) over (partition by doc_id, words[i], words[i + 1], words[i + 2]) as c
  from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w)),
covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from tri where c > 1) group by doc_id),
counts as (select w.doc_id, len(words) as n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) as word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
  len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n, 0) as n_repeat_words, len(lines) as n_lines,
  length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as n_capitals,
  length(text) - length(regexp_replace(text, '[!?]', '', 'g')) as n_marks, len(list_distinct(words)) as n_distinct_words,
  length(text) - length(regexp_replace(text, '[.,;:]', '', 'g')) as n_stops
  from w left join covered using (doc_id)),
voted as materialized (select *, {quality.vote_sql()} as votes from counts),
patterns as materialized (select votes, count(*) as n from voted group by votes),
{quality.fit_sql("patterns")}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > 50 * n_words) and p >= 0.5 as kept,
  votes, round(p, 6) as posterior
from voted join posteriors using (votes)
"""


@query("op6_quality_rules", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = quality.judge(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("row.doc_id", *counts, "base_failed", "kept", "votes", F.round("posterior", 6).alias("posterior"))


OP7_SQL = f"""
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b) as n, sha256(b) as h from p),
f as (select *, case when n >= {warc.MIN_BYTES} then min(page_id) over (partition by h) end as first from d)
select page_id, n::bigint as payload_bytes, h as payload_digest,
  case when first is not null and first is distinct from page_id then 'revisit' else 'response' end as record_type,
  case when first is distinct from page_id then first end as refers_to
from f
"""


@query("op7_warc", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    written = warc.archive(read_table(spark, sf_dir, "pages"), folder)
    n = max(1, written.count())
    back = warc.read(written.repartition(n), folder)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_items(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.size("hits").cast("long").alias("n_hits"),
        F.array_distinct("hits.item_id").alias("items"),
        F.expr("array_join(transform(hits, h -> concat_ws(':', h.item_id, h.start, h.end, h.distance)), ',')").alias("spans"),
    )


@query("op9_unit_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = unit_dedup.dedup(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("removed").cast("long").alias("n_removed"),
        F.expr("aggregate(removed, 0L, (n, r) -> n + r.end - r.start)").alias("removed_chars"),
        F.expr("array_join(transform(removed, r -> concat_ws(':', r.start, r.end)), ',')").alias("spans"),
        F.sha2("text", 256).alias("text_sha256"),
    )


@query("op10_byte_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = bpe.rank_file("byte_bpe_multi_50k.tiktoken"), _pattern()
    encoded = bpe.encode(read_table(spark, sf_dir, "documents"), ranks, pattern)
    decoded = bpe.decode(encoded, ranks, pattern)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


_PIECES = "regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')"
OP11_SQL = f"""
with p as (select coalesce(lang, 'und') as lang, unnest({_PIECES}) as piece from documents),
q as (select lang, row_number() over () as piece, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from p),
t as (select lang, piece, unnest(w) as w1, unnest(range(1, len(w) + 1)) as i from q),
m as (select lang, w1, lead(w1) over pos as w2, lead(w1, 2) over pos as w3 from t window pos as (partition by piece order by i)),
g as (select lang, 1 as k, w1 as phrase from m
  union all select lang, 2, w1 || ' ' || w2 from m where w2 is not null
  union all select lang, 3, w1 || ' ' || w2 || ' ' || w3 from m where w3 is not null),
f as materialized (select lang, k, phrase, count(*) as a from g group by all),
c as materialized (select lang, k, phrase, a, string_split(phrase, ' ') as w from f where k > 1 and a >= 10),
cut as (select lang, k, phrase, a, w, unnest(range(1, k)) as cut from c),
cuts as materialized (select lang, phrase, a, cut, array_to_string(w[1:cut], ' ') as head, array_to_string(w[cut + 1:], ' ') as tail from cut),
scored as (select cuts.lang, cuts.phrase, cuts.a, cuts.cut, h.a as l, t.a as r,
    1000000::hugeint * cuts.a * cuts.a // (h.a::hugeint * t.a) as score
  from cuts join f h on h.lang = cuts.lang and h.phrase = cuts.head join f t on t.lang = cuts.lang and t.phrase = cuts.tail),
weakest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
inner_ as (select lang, w[1] || ' ' || w[2] as phrase, a from c where k = 3 union all select lang, w[2] || ' ' || w[3], a from c where k = 3),
most as (select lang, phrase, max(a) as longer from inner_ group by all),
free as (select weakest.* from weakest left join most using (lang, phrase) where longer is null or 100 * longer < 50 * a),
n as (select lang, sum(a)::bigint as n from f where k = 1 group by lang)
select free.lang, row_number() over (partition by free.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score
from free join n using (lang)
qualify rank <= 2000
"""


@query("op11_collocations", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents").select("text", "lang"))


_FRAME = "case when {0} is null then '-' else octet_length(encode({0}::varchar)) || ':' || {0}::varchar end"
_LEAF = "sha256(" + " || ".join(_FRAME.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"
#: Levels that the SQL spells out: up to 2 ** 20 documents of a language and 2 ** 5 languages.
_LEVELS, _LANG_LEVELS = 20, 5


def _levels(name: str, n: int) -> str:
    """Node tables name0 .. name<n>: two neighbours become one, until one is left."""
    up = "{name}{j} as materialized (select lang, i // 2 as i, (n + 1) // 2 as n, case when n = 1 then min(h) else sha256(string_agg(h, '' order by i)) end as h from {name}{k} group by lang, i // 2, n)"
    return ",\n".join(up.format(name=name, j=k + 1, k=k) for k in range(n))


def _climb(name: str, nodes: str, n: int) -> str:
    """Proof tables name0 .. name<n>: the sibling, where there is one, joins the proof and the digest."""
    up = """{name}{j} as (select f.* exclude (proof, g, i, n), proof || coalesce(s.h, '') as proof,
  case when f.n = 1 then g when s.h is null then sha256(g) when f.i % 2 = 1 then sha256(s.h || g) else sha256(g || s.h) end as g,
  f.i // 2 as i, (f.n + 1) // 2 as n
  from {name}{k} f left join {nodes}{k} s on s.lang is not distinct from f.lang and s.i = xor(f.i, 1) and s.n = f.n)"""
    return ",\n".join(up.format(name=name, nodes=nodes, j=k + 1, k=k) for k in range(n))


OP12_SQL = f"""
with crc_table as (select list(c order by v) as tab from (select v, list_reduce([v] || [0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from (select unnest(range(256)) as v))),
crc as (select doc_id, xor(list_reduce([4294967295] || list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint),
  lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) as c from (select distinct doc_id from documents), crc_table),
d as (select documents.doc_id, lang, {_LEAF.format("n_chars")} as leaf,
  case when c % 7 = 0 and n_chars is not null then {_LEAF.format("(n_chars + 1)")} else {_LEAF.format("n_chars")} end as given
  from documents left join crc using (doc_id)),
l as materialized (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from d),
n0 as materialized (select lang, i, n, leaf as h from l),
{_levels("n", _LEVELS)},
r0 as materialized (select 'all' as lang, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as n, h, lang as name from n{_LEVELS}),
{_levels("r", _LANG_LEVELS)},
f0 as (select doc_id, lang, leaf, given as g, '' as proof, i, n from l),
{_climb("f", "n", _LEVELS)},
s0 as (select f.doc_id, f.leaf, r0.h as subroot, 'all' as lang, f.proof, f.g, r0.i, r0.n from f{_LEVELS} f join r0 on r0.name is not distinct from f.lang),
{_climb("s", "r", _LANG_LEVELS)}
select doc_id, leaf, subroot, root.h as root, sha256(proof) as proof_sha256, g as folded_root, g = root.h as verified
from s{_LANG_LEVELS} cross join r{_LANG_LEVELS} root
"""


@query("op12_merkle_manifest", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    digest = merkle.leaf_digest(*fields)
    changed = merkle.leaf_digest(*(F.col("n_chars") + 1 if c == "n_chars" else c for c in fields))
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    leaves = cut_lineage(
        docs.select(
            F.col("lang").alias("tree"),
            F.col("doc_id").alias("key"),
            digest.alias("leaf"),
            F.struct("doc_id", F.when(tampered, changed).alias("changed")).alias("row"),
        )
    )
    proofs = merkle.manifest(leaves).withColumn("given", F.coalesce("row.changed", "leaf"))
    hexed = lambda c: F.lower(F.hex(c))
    return merkle.folded(proofs, "given").select(
        "row.doc_id",
        hexed("leaf").alias("leaf"),
        hexed("subroot").alias("subroot"),
        hexed("root").alias("root"),
        F.sha2(hexed("siblings"), 256).alias("proof_sha256"),
        hexed("folded_root").alias("folded_root"),
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query("op13_chunk_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.rank_file("byte_bpe_50k.json")
    encoded = chunk_bpe.encode(read_table(spark, sf_dir, "documents"), vocabulary)
    decoded = chunk_bpe.decode(encoded, vocabulary)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
