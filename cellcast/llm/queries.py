"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from . import capfilters, chosenpath, hostrules, langid, merkle, mixing, packing, runs, substrings, tokencount, toxicity, urlfilter, warczip
from .common import held_out



def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file, the same on the driver and the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            folder = sf_dir.rstrip("/")
            return fn(spark, lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


@query(
    "op1_mix_sources",
    r"""
with sized as (
  select doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
         md5(coalesce(cast(doc_id as varchar), '') || ':1') as digest
  from documents),
drawn as (
  select doc_id, source, size, cast('0x' || substr(digest, 1, 3) as bigint) as bucket,
         cast('0x' || substr(digest, 4, 6) as bigint) / 16777216.0 as draw
  from sized),
sources as (
  select source, sum(size) as source_size,
         [5.0, 2.0, 1.0][1 + (row_number() over (order by source nulls last) - 1) % 3]::double as weight
  from drawn group by source),
ordered as (
  select source, source_size, weight, source_size * 3.0::double as cap,
         coalesce(sum(source_size * 3.0::double) over before, 0)::double as held,
         sum(weight) over () - coalesce(sum(weight) over before, 0) as free,
         sum(source_size) over () as total, row_number() over before_all as n
  from sources
  window before as (order by source_size * 3.0::double / weight, source nulls last
                    rows between unbounded preceding and 1 preceding),
         before_all as (order by source_size * 3.0::double / weight, source nulls last)),
fill as (
  select arg_min((total - held) / free, n) filter (where (total - held) / free * weight <= cap) as level
  from ordered),
targets as (
  select source, source_size, least(cap, weight * coalesce(level, 1e300)) as target,
         case when source_size > 0
              then floor(least(cap, weight * coalesce(level, 1e300)) / source_size) else 0 end as repeats
  from ordered, fill),
buckets as (
  select source, bucket, words,
         coalesce(sum(words) over (partition by source order by bucket
                                   rows between unbounded preceding and 1 preceding), 0) as before
  from (select source, bucket, sum(size) as words from drawn group by source, bucket)),
plan as (
  select b.source, b.bucket, t.source_size, t.target, t.repeats, b.words,
         t.target - t.repeats * t.source_size - b.before as remaining
  from buckets b join targets t on b.source is not distinct from t.source)
select d.doc_id, d.size::bigint as size, p.source_size::bigint as source_size, p.target,
       (p.repeats * d.size + floor(d.size * (case when p.remaining <= 0 then 0.0::double
            when p.remaining >= p.words then 1.0::double else p.remaining / p.words end) + d.draw))::bigint as taken
from drawn d join plan p on d.source is not distinct from p.source and d.bucket = p.bucket
""",
)
def op1(spark, table):
    mixed = mixing.mix_sources(table("documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op2_token_counts")
def op2(spark, table):
    docs = table("documents").select("doc_id", "text")
    counted = tokencount.count_tokens(docs, tokenizer_file("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_tokens")


@query("op3_language_id")
def op3(spark, table):
    docs = table("documents")
    net = langid.fit_language_model(docs, ~held_out("doc_id", 4, 2))
    found = langid.predict_languages(docs, net)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


@query(
    "op4_warc_zip",
    r"""
with digests as (
  select page_id, octet_length(encode(coalesce(html, ''))) as bytes, sha1(encode(coalesce(html, ''))) as hex
  from pages),
firsts as (
  select page_id, bytes, hex, min(page_id) over (partition by hex, bytes) as first from digests)
select page_id, bytes::bigint as payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((cast('0x' || substr(hex, 1 + 5 * (i // 4)::int, 5) as bigint) >> (15 - 5 * (i % 4))::int) & 31)::int, 1)), '')
         as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from firsts
""",
)
def op4(spark, table):
    read = warczip.archive_pages(table("pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_toxicity")
def op5(spark, table):
    docs = table("documents").select("doc_id", "text")
    lexicon = toxicity.fit_toxicity(docs, table("labels"), ~held_out("doc_id", 3, 1))
    scored = toxicity.score_toxicity(docs, lexicon)
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


@query("op6_chosen_path")
def op6(spark, table):
    return chosenpath.near_duplicates(table("documents"), chosenpath.PathJoin(percent=85))


@query("op7_cap_filters")
def op7(spark, table):
    return capfilters.link_vectors(table("embeddings"), threshold=0.93)


@query(
    "op8_host_rules",
    r"""
with texts as (
  select row_number() over () as n, doc_id, source, coalesce(text, '') as text from documents),
words as (
  select n, unnest(ws) as w, generate_subscripts(ws, 1) as i
  from (select n, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from texts)),
windows as (
  select n, i, w || ' ' || lead(w, 1) over o || ' ' || lead(w, 2) over o || ' ' || lead(w, 3) over o || ' '
         || lead(w, 4) over o || ' ' || lead(w, 5) over o || ' ' || lead(w, 6) over o || ' ' || lead(w, 7) over o as k
  from words window o as (partition by n order by i)),
marked as (
  select n, i, k is not null and count(*) over (partition by n, k) > 1 as twice from windows),
covered as (
  select n, bool_or(twice) over (partition by n order by i rows between 7 preceding and current row) as again
  from marked),
counted as (
  select n, count(*) as n_words, count(*) filter (where again) as n_repeat_words from covered group by n),
lined as (
  select n, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from texts),
measured as (
  select doc_id, source, coalesce(n_words, 0)::bigint as n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from texts join lined using (n) left join counted using (n)),
judged as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from measured),
hosts as (
  select source, count(*) as n, (count(*) filter (where base_failed)) * 1.0::double as failed from judged group by source),
moments as (
  select avg(failed / n) as mean, var_pop(failed / n) - avg(failed / n * (1 - failed / n) / n) as spread from hosts),
prior as (
  select mean, case when spread > 0 then least(greatest(mean * (1 - mean) / spread - 1, 1.0::double), 1000.0::double)
                    else 1000.0::double end as strength
  from moments)
select j.doc_id, j.n_words, j.word_chars, j.n_symbols, j.n_dup_lines, j.n_repeat_words, j.base_failed,
       not j.base_failed and (h.failed + p.mean * p.strength) / (h.n + p.strength) <= 0.5 as kept
from judged j join hosts h on j.source is not distinct from h.source, prior p
""",
)
def op8(spark, table):
    judged = hostrules.judge_by_host(table("documents"))
    return judged.select("doc_id", *hostrules.MEASURES, "base_failed", "kept")


@query(
    "op9_url_filter",
    r"""
with cut as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages),
hosted as (
  select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from cut),
placed as (
  select row_number() over () as n, page_id,
         translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path
  from hosted),
rules(verdict, rhost, rpath) as (
  values ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
         ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/'))
select page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) as rule,
       coalesce(arg_max(verdict, length(rhost || rpath)), 'allow') as verdict
from placed left join rules
  on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
group by n, page_id, host, path
""",
)
def op9(spark, table):
    rules = urlfilter.rule_table(
        spark,
        [
            ("block", "net", "/"),
            ("allow", "example.net", "/en/"),
            ("block", "example.com", "/de/"),
            ("allow", "org", "/fr/"),
        ],
    )
    judged = urlfilter.judge_urls(table("pages"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op10_vector_packing")
def op10(spark, table):
    return packing.pack_documents(table("documents"), tokenizer_file("word_bpe_49k.json"))


@query(
    "op11_merkle_manifest",
    r"""
with recursive
leaves as materialized (
  select row_number() over () as r, doc_id, source, leaf,
         case when crc % 2 = 0 and text is not null then sha256(head || strlen(cut) || ':' || cut) else leaf end as given
  from (
    select doc_id, source, text, replace(text, chr(10), '') as cut, head,
           sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
           xor(list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda x: ord(x)::bigint),
               lambda c, b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)),
               4294967295::bigint), 4294967295::bigint) as crc
    from (select doc_id, source, text,
                 coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                 || coalesce(strlen(lang) || ':' || lang, '-')
                 || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head
          from documents))),
placed as materialized (
  select r, doc_id, leaf, given, dense_rank() over (order by source nulls first) - 1 as sid,
         row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos,
         count(*) over (partition by source) as n
  from leaves),
nodes(sid, level, pos, digest, n) as (
  select sid, 0, pos, leaf, n from placed
  union all
  select sid, level + 1, pos // 3, sha256(string_agg(digest, '' order by pos)), (n + 2) // 3
  from nodes where n > 1 group by sid, level, pos // 3, n),
subroots as materialized (select sid, digest, count(*) over () as n from nodes where n = 1),
upper_nodes(level, pos, digest, n) as (
  select 0, sid, digest, n from subroots
  union all
  select level + 1, pos // 3, sha256(string_agg(digest, '' order by pos)), (n + 2) // 3
  from upper_nodes where n > 1 group by level, pos // 3, n),
steps as materialized (
  select sid, level, pos, coalesce(string_agg(digest, '') over before, '') as lft,
         coalesce(string_agg(digest, '') over after, '') as rgt
  from nodes where n > 1
  window before as (partition by sid, level, pos // 3 order by pos rows between unbounded preceding and 1 preceding),
         after as (partition by sid, level, pos // 3 order by pos rows between 1 following and unbounded following)),
upper_steps as materialized (
  select level, pos, coalesce(string_agg(digest, '') over before, '') as lft,
         coalesce(string_agg(digest, '') over after, '') as rgt
  from upper_nodes where n > 1
  window before as (partition by level, pos // 3 order by pos rows between unbounded preceding and 1 preceding),
         after as (partition by level, pos // 3 order by pos rows between 1 following and unbounded following)),
walk(r, sid, level, pos, proof, digest) as (
  select r, sid, 0, pos, '', given from placed
  union all
  select w.r, w.sid, w.level + 1, w.pos // 3, w.proof || s.lft || s.rgt, sha256(s.lft || w.digest || s.rgt)
  from walk w join steps s on w.sid = s.sid and w.level = s.level and w.pos = s.pos),
upper_walk(r, sid, level, pos, proof, digest) as (
  select r, sid, 0, sid, arg_max(proof, level), arg_max(digest, level) from walk group by r, sid
  union all
  select w.r, w.sid, w.level + 1, w.pos // 3, w.proof || s.lft || s.rgt, sha256(s.lft || w.digest || s.rgt)
  from upper_walk w join upper_steps s on w.level = s.level and w.pos = s.pos),
ended as (
  select r, sha256(arg_max(proof, level)) as proof_sha256, arg_max(digest, level) as folded_root
  from upper_walk group by r)
select p.doc_id, p.leaf, s.digest as subroot, u.digest as root, e.proof_sha256, e.folded_root,
       e.folded_root = u.digest as verified
from placed p join subroots s using (sid) join ended e using (r), (select digest from upper_nodes where n = 1) u
""",
)
def op11(spark, table):
    text = F.col("text")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    given = F.when(tampered, F.translate(text, "\n", "")).otherwise(text)
    return merkle.prove(table("documents"), given)


@query("op12_suffix_shards")
def op12(spark, table):
    return substrings.repeat_digests(table("documents"), substrings.Repeats(length=400))


def plant_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, by crc32 of the id, repeat some of their words to the end."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


@query("op13_periodic_runs")
def op13(spark, table):
    return runs.run_digests(runs.periodic_runs(table("documents"), change=plant_period))
