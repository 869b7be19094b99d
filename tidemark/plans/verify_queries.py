"""Claims verified whole, over orders as claims with planted pages, recordings, years and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import verification
from ..sources.tables import table
from .registry import query

C = F.col

_CLAIMS = """k AS (SELECT o_orderkey AS claim, o_orderkey AS k FROM orders),
c AS (SELECT claim, k, CASE k % 5 WHEN 0 THEN 'credited_on' WHEN 1 THEN 'member_of' WHEN 2 THEN 'covers' WHEN 3 THEN 'influenced_by' ELSE 'likes' END AS predicate, 'p' || (k % 3) AS source, CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 'inferred' ELSE 'documented' END AS basis,
  'subject ' || lpad(CAST(k // 5 % 40 AS VARCHAR), 2, '0') AS s, CASE WHEN k % 7 = 0 THEN ' studio' ELSE '' END AS tail, 'object ' || lpad(CAST(k // 5 % 30 AS VARCHAR), 2, '0') AS o, 1990 + k % 10 AS sy, 1985 + k % 12 AS oy, 'a' || (k // 3 % 4) AS sa, 'a' || (k // 7 % 4) AS oa,
  CASE k % 11 WHEN 0 THEN 'SUPPORTS' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'DOES_NOT_SUPPORT' END AS verdict FROM k)"""


@query("WITH " + _CLAIMS + """,
r AS (SELECT * FROM (VALUES ('a0', '1970-01-01'), ('a1', '1980-01-01'), ('a2', NULL)) v(artist, first)),
q AS (SELECT c.*, rs.first AS sf, ro.first AS rf, ro.artist AS ra FROM c LEFT JOIN r rs ON rs.artist = sa AND predicate = 'covers' LEFT JOIN r ro ON ro.artist = oa AND predicate = 'covers'),
f AS (SELECT claim, k, predicate, source, s, o, basis, verdict, list_sort(list_filter([CASE WHEN predicate = 'likes' THEN 'unknown predicate' END, CASE WHEN predicate = 'influenced_by' AND basis = 'inferred' THEN 'needs evidence' END, CASE WHEN k % 4 = 3 THEN 'quote not in source' END,
    CASE WHEN predicate IN ('covers', 'influenced_by') AND oy > sy THEN 'object is newer' END, CASE WHEN ra IS NOT NULL AND ra <> 'a0' THEN 'not the first recording' END, CASE WHEN rf > sf THEN 'database contradicts' END, CASE WHEN verdict = 'DOES_NOT_SUPPORT' THEN 'reader rejects' END], lambda x: x IS NOT NULL)) AS fails,
  CASE WHEN rf <= sf OR (predicate = 'member_of' AND k // 5 % 30 % 3 = 0 AND tail = '') THEN ['musicbrainz'] ELSE [] END AS db FROM q),
g AS (SELECT f.*, list_sort(list_distinct(list_concat(db, coalesce((SELECT list(DISTINCT d.source) FROM c d WHERE d.predicate = f.predicate AND d.s = f.s AND d.o = f.o AND d.source <> f.source), [])))) AS support FROM f)
SELECT claim, array_to_string(fails, ';') AS fails, array_to_string(support, ';') AS support, CASE WHEN len(fails) > 0 THEN 0.0 ELSE round(least(CASE basis WHEN 'documented' THEN 0.8 ELSE 0.5 END + 0.1 * len(support), 0.95), 2) END AS confidence,
  CASE WHEN len(fails) > 0 THEN 'rejected' WHEN verdict = 'SUPPORTS' OR (verdict = 'PARTIAL' AND len(db) > 0) THEN 'accepted' WHEN verdict = 'PARTIAL' THEN 'ask' ELSE 'unread' END AS status FROM g""")
def verified_claims(spark, sf_dir):
    """Structure, evidence, dates, covers, databases, independent support, readers' verdicts; then confidence and status."""
    k = C("o_orderkey")
    fifth = F.floor(k / 5)
    two = lambda n: F.lpad((fifth % n).cast("string"), 2, "0")
    tail = F.when(k % 7 == 0, " studio").otherwise("")
    predicate = F.element_at(F.array(*map(F.lit, ("credited_on", "member_of", "covers", "influenced_by", "likes"))), (k % 5 + 1).cast("int"))
    kinds = {"credited_on": ("artist", "album"), "member_of": ("person", "artist"), "covers": ("recording", "recording"), "influenced_by": ("album", "album"), "likes": ("album", "album")}
    kind = lambda i: F.element_at(F.array(*(F.lit(kinds[p][i]) for p in kinds)), (k % 5 + 1).cast("int"))

    def end(i, key, artist, year):
        return F.struct(kind(i).alias("type"), key.alias("name"), key.alias("key"), artist.alias("artist"), year.cast("int").alias("year"), F.lit(False).alias("of_album"))

    subject = end(0, F.concat(F.lit("subject "), two(40), tail), F.concat(F.lit("a"), F.floor(k / 3) % 4), 1990 + k % 10)
    object_ = end(1, F.concat(F.lit("object "), two(30)), F.concat(F.lit("a"), F.floor(k / 7) % 4), 1985 + k % 12)
    orders = table(spark, sf_dir, "orders")
    quote = F.concat(F.lit("«Words of "), k, F.lit("»  as written"))
    claims = orders.select(
        k.alias("claim"), predicate.alias("predicate"), F.concat(F.lit("p"), k % 3).alias("source"), F.lit("writer").alias("extractor"), F.lit("text").alias("kind"), F.when((k % 3 == 0) & (k % 2 == 0), "inferred").otherwise("documented").alias("basis"), F.lit("subject_newer").alias("direction"),
        quote.alias("evidence"), F.concat(F.lit("u"), k % 500, F.lit("#part")).alias("source_url"), F.lit("none").alias("album"), subject.alias("subject"), object_.alias("object"), F.lit(None).cast("string").alias("via"), F.array().cast("array<string>").alias("corroborated"),
    )
    pages = orders.where(k % 4 != 3).groupBy(F.concat(F.lit("u"), k % 500).alias("url")).agg(F.array_join(F.collect_list(F.upper(F.concat(F.lit('"Words of '), k, F.lit('" as written')))), "\n").alias("body"))
    empty = lambda schema: spark.createDataFrame([], schema)
    predicates = spark.createDataFrame([(p, [s], [o]) for p, (s, o) in kinds.items() if p != "likes"], "predicate string, subject_types array<string>, object_types array<string>")
    numbers = table(spark, sf_dir, "nation").select(C("n_nationkey")).union(table(spark, sf_dir, "nation").select(C("n_nationkey") + 25)).where("n_nationkey < 40")
    of = lambda name, n: F.concat(F.lit(f"{name} "), F.lpad(n.cast("string"), 2, "0"))
    works = numbers.where("n_nationkey < 30").select(of("object", C("n_nationkey")).alias("work"))
    dated = F.explode(F.array(*(F.struct(F.lit(a).alias("artist"), F.lit(d).cast("string").alias("first")) for a, d in (("a0", "1970-01-01"), ("a1", "1980-01-01"), ("a2", None)))))
    recordings = works.select("work", dated.alias("r")).select("work", "r.*")
    members = numbers.where("n_nationkey < 30 and n_nationkey % 3 = 0").select(of("object", C("n_nationkey")).alias("band")).crossJoin(F.broadcast(numbers.select(of("subject", C("n_nationkey")).alias("person"))))  # forty rows
    verdict = F.when(k % 11 == 0, "SUPPORTS").when(k % 11 == 1, "PARTIAL").when(k % 11 == 2, "DOES_NOT_SUPPORT")
    reader = orders.select(k.alias("claim"), verdict.alias("verdict")).where("verdict is not null")
    lookups = verification.Lookups(predicates, pages, empty("note string, text string, cites array<string>"), recordings, members, empty("album string, source string, person string"), empty("type string, key string, year int"), empty("album string, year int"), reader)
    found = verification.verify(claims, lookups)
    return found.select("claim", F.array_join("fails", ";").alias("fails"), F.array_join("support", ";").alias("support"), "confidence", "status")
