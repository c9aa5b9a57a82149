"""The corpus operators as named queries over a folder of tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import alignment, bpe, hamming, linededup, lzprint, mixing, packing, pii, quality, sharding, simhash, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


SHARDS_SQL = """
with base as (
  select doc_id, coalesce(text, '') as t, 's' || source as part,
         cast('0x' || substr(md5('42:' || doc_id), 1, 15) as bigint) as draw,
         cast('0x' || substr(md5('42:offset:s' || source), 1, 13) as bigint) / 4503599627370496.0::double as u
  from documents),
ranked as (
  select *, (row_number() over (partition by part order by draw, doc_id) - 1 + u) / count(*) over (partition by part) as position
  from base),
dealt as (select *, row_number() over (order by position, part) - 1 as g, count(*) over () as n from ranked)
select doc_id, cast(strlen(t) + 1 as bigint) as size,
       cast(xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen(t) + 1),
         lambda i: cast('0x' || substr(hex(t), 2 * i - 1, 2) as bigint))),
         lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295) as bigint) as text_crc32,
       'rows' as law, cast(g * 8 // n as integer) as shard,
       cast(g - (((g * 8 // n) * n + 7) // 8) as bigint) as slot, cast(null as integer) as grown_shard, substr(part, 2) as stratum
from dealt, (select list_transform(range(256), lambda c: list_reduce(list_prepend(c::bigint, range(8)),
         lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as crc_table)
"""


@query("op2_shards", SHARDS_SQL)
def op2(spark, folder):
    return sharding.interleave(table(spark, folder, "documents"), shards=8, seed=42)


@query("op3_bpe")
def op3(spark, folder):
    import public_tokenizers

    docs = table(spark, folder, "documents")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


@query("op7_simhash")
def op7(spark, folder):
    return simhash.simhash_groups(table(spark, folder, "documents"), words=3, distance=3)


@query("op10_quality")
def op10(spark, folder):
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"), threshold=0.7)


@query("op8_pii")
def op8(spark, folder):
    return pii.find(table(spark, folder, "documents"))


@query("op1_warc")
def op1(spark, folder):
    return warc.archive_and_read(table(spark, folder, "pages"), least_bytes=0)


@query("op4_lz_fingerprint")
def op4(spark, folder):
    return lzprint.with_edits(table(spark, folder, "documents"))


LINES_SQL = """
with l as (
  select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents),
w as (
  select doc_id, pos, line as a, lead(line, 1) over d as b, lead(line, 2) over d as c from l window d as (partition by doc_id order by pos)),
later as (
  select doc_id, pos from (select *, row_number() over (partition by a, b, c order by doc_id, pos) as n from w where c is not null) where n > 1),
covered as (select distinct doc_id, pos + k as pos from later, (values (0), (1), (2)) as t(k)),
marked as (select l.*, covered.pos is not null as gone from l left join covered using (doc_id, pos))
select doc_id, coalesce(string_agg(case when not gone then line end, chr(10) order by pos), '') as text, cast(count(*) as bigint) as lines,
       cast(sum(gone::int) as bigint) as removed
from marked group by doc_id
"""


@query("op5_lines", LINES_SQL)
def op5(spark, folder):
    out = linededup.drop_repeated_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return out.withColumnsRenamed({"_lines": "lines", "_removed": "removed"})


@query("op6_packing")
def op6(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"))


NEAREST_SQL = """
with codes as (
  select vec_id, list_sum(list_transform(embedding[1:64], lambda x, i: case when x > 0 then 1::hugeint << (i - 1) else 0::hugeint end))::ubigint as code
  from embeddings),
pairs as (
  select q.vec_id as query_id, n.vec_id as neighbour_id, cast(bit_count(xor(q.code, n.code)) as integer) as distance
  from codes q join codes n on q.vec_id % 50 = 0 and q.vec_id != n.vec_id)
select query_id, neighbour_id, distance, cast(rank as integer) as rank
from (select *, row_number() over (partition by query_id order by distance, neighbour_id) as rank from pairs) where rank <= 10
"""


@query("op9_nearest_codes", NEAREST_SQL)
def op9(spark, folder):
    codes = hamming.sign_codes(table(spark, folder, "embeddings"))
    return hamming.nearest_codes(codes, codes.where("id % 50 = 0"), k=10)


@query("op11_align")
def op11(spark, folder):
    import public_tokenizers as files

    return alignment.aligned(table(spark, folder, "documents"), files.path("byte_bpe_50k.json"), files.path("piece_bpe_32k.model"))


@query("op12_whitening")
def op12(spark, folder):
    return whitening.whiten(table(spark, folder, "embeddings"), components=16, weights="one")


MIX_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as z,
         cast('0x' || substr(md5('42:' || coalesce(doc_id::varchar, '')), 1, 15) as bigint) as draw from documents),
src as (
  select source, s, ([5, 2, 1])[(row_number() over (order by source nulls last) - 1) % 3 + 1] as w
  from (select source, sum(z)::bigint as s from d group by source)),
total as (select sum(s)::bigint as t, sum(w)::bigint as w from src),
steep as (
  select src.*, coalesce(sum(3 * s) over o, 0)::bigint as caps, coalesce(sum(src.w) over o, 0)::bigint as ws, total.t, total.w as all_w
  from src, total window o as (order by 3 * s / src.w, source nulls last rows between unbounded preceding and 1 preceding)),
capped as (select *, 3 * s * (all_w - ws) < w * (t - caps) as at_cap from steep),
free as (select (any_value(t) - coalesce(sum(3 * s) filter (at_cap), 0))::double as r, (sum(w) filter (not at_cap))::double as w from capped),
goal as (select source, s, case when at_cap then (3 * s)::double else r * capped.w::double / free.w end as target from capped, free),
sizes as (select source, z, count(*) as n from d where z > 0 group by 1, 2),
hist as (select source, list({'z': z, 'n': n}) as h, min(z) as z0 from sizes group by 1),
ends as (
  select goal.source, s, target, h, case when target >= 3 * s then null else least(ln(target / s) / z0, 0) end as lo,
         case when target > s then ln(3) / z0 else 0 end as hi
  from goal join hist on goal.source is not distinct from hist.source),
tilts as (
  select source, s, target, h, case when lo is not null then list_reduce(
    list_prepend({'lo': lo, 'hi': hi}, list_transform(range(120), lambda i: {'lo': 0::double, 'hi': 0::double})),
    lambda a, x: case when list_sum(list_transform(h, lambda e: e.n * e.z * least(3, exp((a.lo + a.hi) / 2 * e.z)))) < target
                 then {'lo': (a.lo + a.hi) / 2, 'hi': a.hi} else {'lo': a.lo, 'hi': (a.lo + a.hi) / 2} end) end as b
  from ends),
rates as (
  select t.source, e.z, e.n, t.target, case when t.b is null then 3 else least(3, exp((t.b.lo + t.b.hi) / 2 * e.z)) end as r
  from tilts t, unnest(t.h) as u(e)),
cuts as (
  select *, floor(sum(cast(n * r as decimal(28, 9))) over (partition by source order by z desc) + 0.5)::bigint as c from rates),
first_k as (
  select source, z, n, round(target)::bigint as want,
         greatest(0, least(c - coalesce(lag(c) over (partition by source order by z desc), 0), 3 * n))::bigint as k from cuts),
miss as (
  select source, (any_value(want) - sum(k * z))::bigint as e, list(z order by z desc) as zs,
         list(case when want_more then 3 * n - k else k end order by z desc) as free
  from (select *, any_value(want) over p - sum(k * z) over p > 0 as want_more from first_k window p as (partition by source)) group by source),
mended as (
  select source, e, zs, list_reduce(
    list_prepend({'e': abs(e), 'q': []::bigint[]}, list_transform(zs, lambda z, i: {'e': z, 'q': [free[i]::bigint]})),
    lambda a, x: {'e': (a.e - least(x.q[1], a.e // x.e) * x.e)::bigint, 'q': list_append(a.q, least(x.q[1], a.e // x.e)::bigint)}) as m
  from miss),
change as (select source, unnest(zs) as z, case when e > 0 then 1 else -1 end * unnest(m.q) as q from mended),
copies as (
  select f.source, f.z, f.n, f.k + c.q as k from first_k f join change c on f.source is not distinct from c.source and f.z = c.z),
ranked as (select *, row_number() over (partition by source, z order by draw, doc_id nulls first) - 1 as rank from d)
select doc_id, ranked.z as size, goal.s as source_size, target,
       cast(coalesce(copies.k // copies.n + (rank < copies.k % copies.n)::int, 0) * ranked.z as bigint) as taken,
       cast(coalesce(copies.k // copies.n + (rank < copies.k % copies.n)::int, 0) as integer) as copies
from ranked join goal on ranked.source is not distinct from goal.source
left join copies on ranked.source is not distinct from copies.source and ranked.z = copies.z
"""


@query("op13_mixing", MIX_SQL)
def op13(spark, folder):
    return mixing.mix(table(spark, folder, "documents"), weights=(5, 2, 1), most=3, seed=42)
