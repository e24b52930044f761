"""One query a list number: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embedding_dedup, jaccard, kneser_ney, language_id, merkle, packing, periodic, substring_dedup, topk, url_filter, warc
from .common import learns

#: The rules of the URL filter: verdict, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = kneser_ney.train(docs.filter(learns("doc_id", 5, 1)))
    return kneser_ney.score(docs, model, "doc_id", (~learns("doc_id", 5, 1)).alias("held_out"))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(learns("doc_id", 3, 1)))
    return language_id.predict(docs.select("doc_id", (~learns("doc_id", 3, 1)).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hit_words")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"), shingle=3, num=90).select("doc_id", "n_shingles", "component_id")


def op10_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.matrices(table(spark, sf_dir, "documents"), tokenizer_file())


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = table(spark, sf_dir, "documents").select(*fields)
    altered = merkle.leaf(*[F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in fields])
    # The leaf of the row as it may have been tampered with; null: as it was.
    docs = docs.withColumn("altered", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, altered))
    found = merkle.manifest(docs, fields, keep=["altered"]).withColumn("folded_root", merkle.folded(F.coalesce("altered", "leaf"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.filter("vec_id % 50 = 0"), k=5, scale=256)


def _looped(doc_id: Column, text: Column) -> Column:
    """The text whose words from a on repeat the first p of them, for a tenth of the documents; the others' as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def turned(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        at = F.sequence(F.lit(0).cast("long"), n - 1)
        return F.array_join(F.transform(at, lambda i: F.get(words, F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int"))), " ")

    # As a lambda's variable the words are split once, not once for each of them.
    return F.when((h % 10 == 0) & (F.size(words) > 0), F.get(F.transform(F.array(words), turned), F.lit(0))).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic.periodic_runs(docs.select("doc_id", _looped(F.col("doc_id"), F.col("text")).alias("text")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "strongest.start",
        "strongest.length",
        "strongest.period",
        F.expr("strongest.length * 1000 div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


#: DuckDB SQL for the queries that SQL can express.
WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


ASCII = r"list_filter(regexp_split_to_array({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


def _sql_crc32(text: str) -> str:
    """crc32 of an ASCII text, bit by bit."""
    byte = f"list_transform(range(1, length({text}) + 1), lambda i: cast(ascii(substr({text}, i, 1)) as bigint))"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295, {byte}), lambda c, b: {bits}), 4294967295)"


def _sql_leaf(*fields: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(cast(strlen(cast({f} as varchar)) as varchar) || ':' || cast({f} as varchar), '-')" for f in fields) + ")"


def _merkle_sql() -> str:
    changed = "case when crc % 2 = 0 then replace(text, chr(10), '') else text end"
    up = "select grp, i // 3 i, lvl + 1 lvl, (any_value(n) + 2) // 3 n, sha256(string_agg(d, '' order by i)) d from {0} where n > 1 group by grp, lvl, i // 3"
    # What stands left and right of a node in its run.
    beside = "select a.grp, a.i, a.lvl, coalesce(string_agg(b.d, '' order by b.i) filter (where b.i < a.i), '') l, coalesce(string_agg(b.d, '' order by b.i) filter (where b.i > a.i), '') r from {0} a join {0} b on a.grp = b.grp and a.lvl = b.lvl and a.i // 3 = b.i // 3 where a.n > 1 group by 1, 2, 3"
    return f"""
with recursive c as (select *, {_sql_crc32("cast(doc_id as varchar)")} crc from documents),
f as materialized (select doc_id, coalesce('=' || source, '') grp, {_sql_leaf("doc_id", "source", "lang", "n_chars", "text")} leaf, {_sql_leaf("doc_id", "source", "lang", "n_chars", f"({changed})")} altered from c),
k as materialized (select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 i, count(*) over (partition by grp) n from f),
t(grp, i, lvl, n, d) as (select grp, i, 0, n, leaf from k union all {up.format("t")}),
tops as materialized (select grp, d subroot, row_number() over (order by grp) - 1 i, count(*) over () n from t where n = 1),
s(grp, i, lvl, n, d) as (select '', i, 0, n, subroot from tops union all {up.format("s")}),
tb as materialized ({beside.format("t")}), sb as materialized ({beside.format("s")}),
levels as (select unnest(range(0, 40)) lvl),
steps as (select k.grp, k.i, list(l || ':' || r order by b.lvl) x from k, levels v, tb b where b.grp = k.grp and b.lvl = v.lvl and b.i = k.i // cast(pow(3, v.lvl) as bigint) group by 1, 2),
above as (select p.grp, list(l || ':' || r order by b.lvl) x from tops p, levels v, sb b where b.lvl = v.lvl and b.i = p.i // cast(pow(3, v.lvl) as bigint) group by 1),
p as (select k.*, subroot, (select d from s where n = 1) root, list_concat(coalesce(steps.x, []), coalesce(above.x, [])) x from k join tops on tops.grp = k.grp left join steps on steps.grp = k.grp and steps.i = k.i left join above on above.grp = k.grp),
q as (select *, list_reduce(list_prepend(altered, x), lambda a, b: sha256(split_part(b, ':', 1) || a || split_part(b, ':', 2))) folded_root from p)
select doc_id, leaf, subroot, root, sha256(replace(array_to_string(x, ''), ':', '')) proof_sha256, folded_root, folded_root = root verified from q"""


def _periodic_sql() -> str:
    own = WORDS.format("coalesce(text, '')")
    return f"""
with c as (select doc_id, {own} ws, {_sql_crc32("cast(doc_id as varchar)")} h from documents),
w as materialized (select doc_id, case when h % 10 = 0 and len(ws) > 0 then list_transform(range(0, len(ws)), lambda i:
    ws[cast(case when i >= (h // 10) % len(ws) then (h // 10) % len(ws) + (i - (h // 10) % len(ws)) % (1 + (len(ws) - (h // 10) % len(ws)) // (3 + (h // 10) % 8)) else i end as bigint) + 1]) else ws end ws from c),
g as materialized (select doc_id, i, md5(array_to_string(list_slice(ws, i + 1, i + 16), ' ')) x, len(ws) n from (select doc_id, ws, unnest(range(0, len(ws) - 15)) i from w where len(ws) >= 24)),
pairs as (select a.doc_id, a.i, b.i - a.i d, a.i - row_number() over (partition by a.doc_id, b.i - a.i order by a.i) part from g a join g b on a.doc_id = b.doc_id and a.x = b.x and b.i > a.i and 3 * (b.i - a.i) <= a.n),
same as (select doc_id, d, min(i) s, count(*) + 15 + d as length from pairs group by doc_id, d, part),
runs as materialized (select doc_id, s, length, min(d) q from same where length >= greatest(24, 3 * d) group by 1, 2, 3),
gone as (select doc_id, list(distinct spot) spots from (select doc_id, unnest(range(s + q, s + length)) spot from runs) group by 1),
best as (select doc_id, s, length, q, row_number() over (partition by doc_id order by cast(length as decimal(38, 0)) * 1000000000000 // q desc, s, q) k from runs),
sums as (select doc_id, count(*) n, string_agg(s || ',' || length || ',' || q || chr(10), '' order by s, q) lines from runs group by 1)
select w.doc_id, coalesce(n, 0) n_runs, s as start, best.length, q as period, best.length * 1000 // q exponent_milli, sha256(coalesce(lines, '')) runs_sha256,
  sha256(array_to_string(case when spots is null then ws else list_transform(list_filter(list_zip(ws, range(0, len(ws))), lambda z: not list_contains(spots, z[2])), lambda z: z[1]) end, ' ')) collapsed_sha256
from w left join sums using (doc_id) left join best on best.doc_id = w.doc_id and k = 1 left join gone on gone.doc_id = w.doc_id"""


def _sql_uuid(seed: str) -> str:
    h = f"md5({seed})"
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


def _sql_resolved(text: str) -> str:
    for reference, char in warc.REFERENCES:
        text = f"replace({text}, '{reference}', '{char.replace(chr(39), chr(39) * 2)}')"
    return text


def _warc_sql() -> str:
    sub = lambda x, pattern, by: f"regexp_replace({x}, '{pattern}', {by}, 'g')"
    text = _sql_resolved(sub(sub(sub("html", warc.HIDDEN, "''"), warc.LINE, "chr(10)"), warc.TAG, "''"))
    text = "trim(" + sub(sub(text, r"[ \t\r\f]+", "' '"), r" ?\n[ \n]*", "chr(10)") + ", ' ' || chr(10))"
    crlf = "chr(13) || chr(10)"
    return rf"""
with p as (select page_id, url, coalesce(html, '') html, {_sql_uuid("'response|' || page_id || coalesce('|' || url, '')")} rid,
  strftime(make_timestamp((1704067200 + page_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') as dt,
  'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(coalesce(html, '')) as headers from pages),
q as (select *, {_sql_uuid("'conversion|' || rid")} cid, {_sql_uuid("'metadata|' || rid")} mid, 'sha256:' || sha256(html) digest, {text} txt,
  trim(regexp_replace({_sql_resolved(f"regexp_extract(html, '{warc.TITLE}', 1)")}, '\s+', ' ', 'g'), ' ') title,
  regexp_extract(html, '{warc.LANG}', 1) lang, regexp_extract_all(html, '{warc.LINK}', 1) links from p),
r as (select *, 'title: ' || title || {crlf} || 'language: ' || lang || {crlf} || 'source-payload-digest: ' || digest || {crlf} || 'outlink-count: ' || len(links)
  || array_to_string(list_transform(links, lambda x: {crlf} || 'outlink: ' || x), '') || {crlf} meta from q),
s as (select page_id, 'conversion' as type, cid record_id, rid refers_to, cast(null as varchar) concurrent_to, url target_uri, dt as date, 'text/plain; charset=utf-8' content_type, headers source_headers, digest source_payload_digest, txt block from r
  union all select page_id, 'metadata', mid, rid, cid, url, dt, 'application/warc-fields', headers, digest, meta from r)
select * exclude (block), 'sha256:' || sha256(block) block_digest, cast(strlen(block) as bigint) content_length, block from s"""


def oracle_sql() -> dict[str, str]:
    words = WORDS.format(LOWER.format("coalesce(text, '')"))
    own_words = WORDS.format("coalesce(text, '')")
    ascii_words = ASCII.format(LOWER.format("coalesce(text, '')"))
    rule = lambda verdict, host, path: f"('{verdict}', '{host}', '{path}')"
    return {
        "op2_warc_derivatives": _warc_sql(),
        "op11_merkle_manifest": _merkle_sql(),
        "op12_exact_topk": """
with v as materialized (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, cast(coalesce(list_dot_product(q.e, c.e), 0) as bigint) score from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e))
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s qualify rank <= 5""",
        "op13_periodic_runs": _periodic_sql(),
        "op3_embedding_dedup": """
with recursive v as materialized (select vec_id, list_transform(embedding, lambda x: cast(x as double)) e from embeddings),
ok as materialized (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) norm from v where len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as materialized (select a.vec_id a, b.vec_id b from ok a join ok b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_dot_product(a.e, b.e) >= 0.9 * a.norm * b.norm),
reach(a, c) as (select vec_id, vec_id from v union select l.b, r.c from reach r join links l on l.a = r.a where r.c < l.b),
low as (select a, min(c) c from reach group by 1), n as (select a, count(*) n from links group by 1)
select vec_id, coalesce(n, 0) n_links, c component_id, vec_id = c kept from v join low on low.a = vec_id left join n on n.a = vec_id""",
        "op5_substring_dedup": f"""
with w as materialized (select doc_id, {own_words} ws from documents),
g as materialized (select doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) h from (select doc_id, ws, unnest(range(1, len(ws) - 48)) i from w where len(ws) >= 50)),
least as (select h, min(doc_id) least from g group by 1),
gone as (select distinct doc_id, unnest(range(i, i + 50)) spot from g join least using (h) where doc_id > least),
lost as (select doc_id, count(*) n, list(spot) spots from gone group by 1)
select w.doc_id, cast(len(ws) as bigint) n_words, coalesce(n, 0) n_removed,
  sha256(array_to_string(case when n is null then ws else list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda z: not list_contains(spots, z[2])), lambda z: z[1]) end, ' ')) kept_sha256
from w left join lost using (doc_id)""",
        "op7_decontaminate": f"""
with w as materialized (select doc_id, {ascii_words} ws from documents),
b as (select item_id, {ascii_words} ws from benchmark),
win as materialized (select distinct item_id, len(x) n, array_to_string(x, ' ') x from (select item_id, list_slice(ws, i, i + 9) x from (select item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) i from b where len(ws) > 0))),
sizes as (select distinct n from win),
g as materialized (select doc_id, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') x from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) i from w, sizes where len(ws) >= n)),
hit as materialized (select doc_id, i, n, item_id from g join win using (n, x)),
words as (select doc_id, count(*) n_hit from (select distinct doc_id, unnest(range(i, i + n)) from hit) group by 1),
items as (select doc_id, count(distinct item_id) n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) ids from hit group by 1)
select w.doc_id, cast(len(ws) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from w left join words using (doc_id) left join items using (doc_id)""",
        "op8_url_filter": f"""
with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
p as materialized (select page_id, {LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r(verdict, h, p) as (values {', '.join(rule(*x) for x in RULES)}),
f as (select page_id, h || r.p as rule, verdict, row_number() over (partition by page_id order by length(h || r.p) desc, length(r.p) desc) k
  from p join r on (host = h or ends_with(host, '.' || h)) and starts_with(p.path, r.p))
select p.page_id, host, p.path, f.rule, coalesce(f.verdict, 'allow') verdict from p left join f on f.page_id = p.page_id and k = 1""",
        "op9_ngram_jaccard": f"""
with recursive w as materialized (select doc_id, {words} ws from documents),
s as materialized (select distinct doc_id, case when len(ws) < 3 then array_to_string(ws, ' ') else array_to_string(list_slice(ws, i, i + 2), ' ') end sh
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) i from w where len(ws) > 0)),
n as materialized (select doc_id, count(*) n from s group by 1),
links as materialized (select a.doc_id a, b.doc_id b from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id
  join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id group by 1, 2, x.n, y.n having 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach(a, c) as (select doc_id, doc_id from w union select l.b, r.c from reach r join links l on l.a = r.a where r.c < l.b)
select w.doc_id, coalesce(n.n, 0) n_shingles, (select min(c) from reach r where r.a = w.doc_id) component_id from w left join n using (doc_id)""",
    }
