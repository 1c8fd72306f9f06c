"""Registered queries of the operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from determina.llm import automata, bwt, decontaminate, hnsw, langid, lbl, licenses, minhash, periods, pieces, sharding, trie, urls
from determina.llm.shared import crc_mod

SHARDS = [f"shard-{i:04d}" for i in range(1000)]
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_vectors(_table(spark, sf_dir, "embeddings"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_table(spark, sf_dir, "documents"), SHARDS).select("doc_id", "slot", "shard")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source, then a directory of a hundred ids, then the id."""
    path = F.concat_ws("/", "row.source", F.floor(F.col("row.doc_id") / 100).cast("string"), F.col("row.doc_id").cast("string"))
    found = licenses.inherit(licenses.scan(_table(spark, sf_dir, "documents")), path, share=0.2)
    return found.select("row.doc_id", "path", "license", F.round("score", 6).alias("score"), "is_license_file", "effective", "origin", "from_dir")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.identify(docs, model).select("row.doc_id", "lang_pred", "score").select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op6_lbl(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lbl.score_texts(_table(spark, sf_dir, "documents"))
    return scored.withColumn("held_out", crc_mod("doc_id", 7) == 2)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("row.doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages")).select("row.page_id", "host", "path", "rule", "verdict")


def op9_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.digests(_table(spark, sf_dir, "documents"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every text, and whether they decode to it."""
    docs = _table(spark, sf_dir, "documents")
    coded = pieces.encode(docs, pieces.load_pieces())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = automata.digests(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation begins with turns of the one whose id is the multiple of five below."""
    turns = trie.numbered_turns(_table(spark, sf_dir, "conversations"))
    keep = (F.crc32(F.col("conv").cast("string").cast("binary")) % 9).cast("long")
    nodes = trie.prefix_trie(*trie.shared_starts(turns, F.col("conv") - F.col("conv") % 5, keep, 8))
    return nodes.select(F.col("seq").alias("conv_id"), "depth", F.col("parent_seq").alias("parent_conv_id"), F.col("n_seqs").alias("n_convs"),
                        "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


def _repeated_tail(doc_id, text):
    """A tenth of the documents with a part that begins anew every few words: with h = crc32 of the id
    and g = h / 10, words from number a = g % n on are those of the p words there, again and again."""
    crc = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(crc / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), 1, n - a)
    new = F.array_join(F.concat(F.slice(words, 1, a), tail), " ")
    return F.when((crc % 10 == 0) & (n > 0), new).otherwise(text)


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periods.periodic_runs(docs.withColumn("text", _repeated_tail(F.col("doc_id"), F.col("text"))))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    return found.withColumn("best", best).select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), "best.length",
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_minhash, op2_hnsw, op3_sharding, op4_licenses, op5_language, op6_lbl, op7_decontaminate, op8_urls, op9_bwt, op10_pieces, op11_automata, op12_trie, op13_periods)}

WORDS_SQL = f"""
list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{SMALL}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"""

OP1_SQL = f"""
with recursive w as (select doc_id, {WORDS_SQL} ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
      else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) end) sh from w),
n as (select doc_id, count(*) n from s group by 1),
p as (select x.doc_id a, y.doc_id b, count(*) c from s x join s y using (sh) where x.doc_id <> y.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
r(doc_id, comp) as (select doc_id, doc_id from documents union select l.b, r.comp from r join l on l.a = r.doc_id),
g as (select doc_id, min(comp) component_id from r group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, g.component_id, d.doc_id = g.component_id kept
from documents d join g using (doc_id) left join n using (doc_id)
"""

OP2_SQL = """
with recursive l as (select a.vec_id a, b.vec_id b from embeddings a join embeddings b
  on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.98),
r(vec_id, comp) as (select vec_id, vec_id from embeddings union select l.b, r.comp from r join l on l.a = r.vec_id),
g as (select vec_id, min(comp) component_id from r group by 1), n as (select a vec_id, count(*) n from l group by 1)
select e.vec_id, coalesce(n, 0)::bigint n_links, component_id, e.vec_id = component_id kept
from embeddings e join g using (vec_id) left join n using (vec_id)
"""

OP7_WORDS = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{SMALL}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
OP7_SQL = f"""
with d as (select doc_id, {OP7_WORDS} ws from documents), b as (select item_id, {OP7_WORDS} ws from benchmark),
bw as (select distinct item_id, least(len(ws), 10) k, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1),
       lambda i: array_to_string(ws[i:i+9], ' '))) win from b where len(ws) > 0),
ks as (select distinct k from bw),
dw as (select doc_id, k, unnest(range(1, len(ws) - k + 2)) pos, ws from d, ks where len(ws) >= k),
h as (select doc_id, pos, dw.k, item_id from dw join bw on dw.k = bw.k and array_to_string(ws[pos:pos+dw.k-1], ' ') = win),
p as (select doc_id, count(distinct x) n_hit from (select doc_id, unnest(range(pos, pos + k)) x from h) group by 1),
i as (select doc_id, count(*) n_items, string_agg(id, ',' order by id) ids from (select distinct doc_id, item_id::varchar id from h) group by 1)
select d.doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join p using (doc_id) left join i using (doc_id)
"""


def _rule_sql() -> str:
    return ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)


OP8_SQL = f"""
with u as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{SMALL}') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from u),
rules(v, h, s) as (values {_rule_sql()}),
f as (select page_id, arg_max(h || s, length(h || s)) rule, arg_max(v, length(h || s)) v from p join rules
      on (host = h or ends_with(host, '.' || h)) and starts_with(path, s) group by 1),
bad(h) as (values {", ".join(f"('{h}')" for h in urls.BLOCKED)})
select page_id, host, path, rule, coalesce(v, case when exists (select 1 from bad where host = bad.h or ends_with(host, '.' || bad.h)) then 'block' else 'allow' end) verdict
from p left join f using (page_id)
"""

OP11_SQL = """
with w as (select row_number() over () r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws from documents),
s as (select r, unnest(range(1, len(ws) - 33)) pos, ws from w where len(ws) >= 35),
k as (select r, pos, sha256(array_to_string(ws[pos:pos+34], ' ')) h from s),
t as (select h from k group by 1 having count(*) > 1),
g as (select r, list(distinct x) xs from (select r, unnest(range(pos, pos + 35)) x from k semi join t using (h)) group by 1)
select doc_id, len(ws)::bigint n_words, coalesce(len(xs), 0)::bigint n_removed,
  sha256(coalesce(array_to_string(case when xs is null then ws else list_filter(ws, lambda x, i: not list_contains(xs, i)) end, ' '), '')) kept_sha256
from w left join g using (r)
"""

OP12_SQL = """
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first) pos,
             sha256(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) tok, strlen(coalesce(text, '')) bytes
           from conversations where conv_id is not null),
b as (select conv_id, flatten(list_transform(string_split(conv_id::varchar, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])) steps
      from (select distinct conv_id from t)),
c as (select conv_id, conv_id - conv_id % 5 base, xor(list_reduce(list_concat([4294967295::bigint], steps),
        lambda acc, e: case when e >= 0 then xor(acc, e) else xor(acc >> 1, 3988292384 * (acc & 1)) end), 4294967295::bigint) % 9 h from b),
w as (select conv_id, list(tok order by pos) toks, list(bytes order by pos) sizes from t group by 1),
r as (select c.conv_id, list_concat(coalesce(p.toks[1:h], []), o.toks[h+1:]) toks, list_concat(coalesce(p.sizes[1:h], []), o.sizes[h+1:]) sizes
      from c join w o on o.conv_id = c.conv_id left join w p on p.conv_id = c.base),
m as (select conv_id, d, array_to_string(toks[1:d], ',') k, array_to_string(toks[1:d-1], ',') pk, coalesce(sizes[d], 0) bytes, d = len(toks) ended
      from (select conv_id, toks, sizes, unnest(range(0, len(toks) + 1)) d from r)),
n as (select d, k, min(conv_id) conv_id, count(*) n, any_value(pk) pk, any_value(bytes) bytes,
        sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ended), '')) ends from m group by 1, 2),
ch as (select d - 1 d, pk k, count(*) n_children from n where d > 0 group by 1, 2),
a as (select n.conv_id, n.d, n.k, n.n, n.pk, n.bytes, n.ends, coalesce(ch.n_children, 0) n_children from n left join ch using (d, k)),
up as (select m.d, m.k, sum(case when a.n_children = 0 then 1 else 0 end) n_leaves, sum((a.n - 1) * a.bytes) saved
       from a join m on m.conv_id = a.conv_id and m.d <= a.d group by 1, 2)
select a.conv_id::bigint conv_id, a.d::bigint "depth", p.conv_id::bigint parent_conv_id, a.n::bigint n_convs, a.n_children::bigint n_children,
  up.n_leaves::bigint n_leaves, up.saved::bigint saved_tokens, a.ends ends_sha256
from a join up using (d, k) left join n p on p.d = a.d - 1 and p.k = a.pk
"""

ORACLE = {"op1_minhash": OP1_SQL, "op2_hnsw": OP2_SQL, "op7_decontaminate": OP7_SQL, "op8_urls": OP8_SQL, "op11_automata": OP11_SQL, "op12_trie": OP12_SQL}
