"""The library's operators on the star-schema tables, and the SQL that must give the same rows.

Events stand for variants: a user is a gene, an event's minute of the day a position, its type a consequence. Users also
get a made-up coding sequence, derived from their id, so that whole jobs run on the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coding as C
from ..functions.stats import fisher, log10_or_null, monte_carlo_p, with_share
from ..operators.cover import greedy_cover, in_intervals, left_over, most_held
from ..operators.distances import mean_of_counted, mean_of_counted_3d
from ..operators.intervals import joined_intervals, nearest_intervals
from ..operators.simulate import p_values
from ..operators.sites import class_sums, drawn, rates_by_class, unmasked, with_context_rates, with_prefix_sums
from ..sources.rates import read_context_rates
from ..sources.trinucleotide_rates import TRINUCLEOTIDE_RATES
from ..sources.structures import without_gap
from ..sources.variants import counted_positions, enough_variants, grouped_variants, many_missense, repeated, usable_variants
from .api import cluster, gene_rates, observed_clustering, transcripts_with_variants


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Events as variants: fixed stand-ins for consequences and kinds.
EVENTS_SQL = """WITH v AS (SELECT CAST(user_id AS VARCHAR) AS gene, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS pos, event_id,
 CASE WHEN event_type = 'signup' THEN NULL WHEN event_type = 'error' THEN 'missense' WHEN event_type = 'purchase' THEN 'nonsense' END AS cls, event_type
 FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    kind = F.create_map(*map(F.lit, ("error", "missense_variant", "purchase", "stop_gained", "click", "synonymous_variant", "view", "intron_variant", "signup", "frameshift_variant")))
    return e.select(F.col("user_id").cast("string").alias("gene"), F.lit("1").alias("chrom"), (F.hour("ts") * 60 + F.minute("ts")).alias("pos"), kind[F.col("event_type")].alias("consequence"), F.when(F.col("event_type") == "signup", "DENOVO-INDEL").otherwise("DENOVO-SNP").alias("var_type"))


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usable_variants(_events(spark, sf_dir))


@_query(EVENTS_SQL + " SELECT gene, pos, cls, count(*) AS n FROM v WHERE event_type <> 'signup' GROUP BY ALL")
def class_filter(spark, sf_dir):
    """Indels go, consequences become classes, others stay without one."""
    return _variants(spark, sf_dir).groupBy("gene", "pos", "cls").agg(F.count("*").alias("n"))


@_query(EVENTS_SQL + " SELECT gene FROM v WHERE event_type <> 'signup' GROUP BY gene HAVING count(cls) >= 2")
def min_events_gate(spark, sf_dir):
    return enough_variants(_variants(spark, sf_dir))


@_query(
    EVENTS_SQL
    + """, m AS (SELECT gene, pos, row_number() OVER (PARTITION BY gene ORDER BY pos, event_id) AS k FROM v WHERE cls = 'missense'),
 p AS (SELECT a.gene, abs(a.pos - b.pos) AS d FROM m a JOIN m b ON a.gene = b.gene AND a.k < b.k),
 z AS (SELECT gene, CASE WHEN bool_or(d = 0) THEN 1 ELSE 0 END AS z FROM p GROUP BY gene)
 SELECT p.gene, count(*) AS n_pairs, round(exp(avg(ln(d + z))) - max(z), 6) AS dist FROM p JOIN z USING (gene) GROUP BY p.gene"""
)
def pairwise_geomean(spark, sf_dir):
    """The geometric mean of all distances between a gene's missense positions."""
    n = F.col("n")
    return counted_positions(_variants(spark, sf_dir), "missense").where(n > 1).select("gene", F.floor(n * (n - 1) / 2).alias("n_pairs"), F.round(mean_of_counted("pos", "counts"), 6).alias("dist"))


@_query(
    """SELECT i.user_id, i.event_id AS interval_id, count(e.event_id) AS n FROM events i LEFT JOIN events e
 ON e.user_id = i.user_id AND e.event_type <> 'signup' AND e.ts BETWEEN i.ts AND i.ts + INTERVAL 6 HOUR WHERE i.event_type = 'signup' GROUP BY ALL"""
)
def range_join_in_interval(spark, sf_dir):
    """Variants in intervals: an equality on the gene carries the range condition."""
    e = _table(spark, sf_dir, "events")
    i = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("interval_id"), F.col("ts").alias("s"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("e"))
    v = e.where("event_type <> 'signup'").select("user_id", F.col("ts").alias("at"), "event_id")
    return in_intervals(i, v, "user_id").groupBy("user_id", "interval_id").agg(F.count("event_id").alias("n"))


@_query(
    """WITH x AS (SELECT user_id, CAST(event_id AS INTEGER) AS s, CAST(event_id AS INTEGER) + 2 AS e FROM events WHERE event_type = 'purchase'),
 j AS (SELECT v.user_id, v.event_id, s, e, CASE WHEN v.event_id BETWEEN s AND e THEN 0 ELSE least(abs(s - v.event_id), abs(e - v.event_id)) END AS gap
 FROM events v JOIN x ON v.user_id = x.user_id WHERE v.event_type = 'error')
 SELECT user_id, event_id, CAST(gap AS BIGINT) AS gap, s, e FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY gap, s, e) AS k FROM j) WHERE k = 1"""
)
def nearest_interval(spark, sf_dir):
    """The closest exon of each variant."""
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    exons = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("s"), (F.col("event_id") + 2).alias("e"))
    near = nearest_intervals(exons, e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("at")), "user_id")
    return near.select("user_id", F.col("at").alias("event_id"), "gap", F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"))


@_query("SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS cumulative FROM events")
def prefix_sum(spark, sf_dir):
    sites = _table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return with_prefix_sums(sites, ("user_id",), ("event_id",), "value").select("user_id", "event_id", F.round("cumulative", 4).alias("cumulative"))


#: A uniform number above 0 from a text, the same in both engines.
_UNIFORM_SQL = "((CAST(CAST(('0x' || substr(md5({0}), 1, 13)) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)"


def _uniform(text):
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / 4503599627370496.0


@_query(
    f"""WITH w AS (SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS w FROM events WHERE value > 0),
 c AS (SELECT *, CAST(sum(w) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM w),
 t AS (SELECT user_id, max(cum) AS total FROM c GROUP BY user_id), k AS (SELECT unnest(range(5)) AS k),
 d AS (SELECT user_id, k, total * {_UNIFORM_SQL.format("user_id || '|' || k")} AS u FROM t, k)
 SELECT d.user_id, d.k, c.event_id FROM d JOIN c ON c.user_id = d.user_id AND d.u > c.cum - c.w AND d.u <= c.cum"""
)
def weighted_sample(spark, sf_dir):
    """Draws with replacement by weight: a number falls between two prefix sums of its own group."""
    w = _table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("w")).where("w > 0")
    c = with_prefix_sums(w, ("user_id",), ("event_id",), "w")
    d = w.groupBy("user_id").agg(F.sum("w").alias("total")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    d = d.select("user_id", "k", (F.col("total") * _uniform(F.concat_ws("|", "user_id", "k"))).alias("u"))
    return drawn(c, d, "user_id", "event_id").select("user_id", "k", "event_id")


ROUNDS = 2_000


@_query(
    EVENTS_SQL
    + f""", s AS (SELECT gene, pos, row_number() OVER (PARTITION BY gene ORDER BY pos, event_id) AS at, count(*) OVER (PARTITION BY gene) AS total FROM v),
 o AS (SELECT gene, pos, row_number() OVER (PARTITION BY gene ORDER BY pos, event_id) AS k, count(*) OVER (PARTITION BY gene) AS n FROM v WHERE cls = 'missense'),
 t AS (SELECT gene, max(n) AS n, max(total) AS total FROM o JOIN (SELECT DISTINCT gene, total FROM s) USING (gene) WHERE n >= 2 GROUP BY gene),
 d AS (SELECT gene, i, j, CAST(floor(total * {_UNIFORM_SQL.format("gene || '|' || i || '|' || j")}) AS BIGINT) + 1 AS at FROM (SELECT gene, total, i, unnest(range(n)) AS j FROM t, (SELECT unnest(range({ROUNDS})) AS i))),
 g AS (SELECT d.gene, d.i, d.j, s.pos FROM d JOIN s ON s.gene = d.gene AND s.at = d.at UNION ALL SELECT o.gene, -1, k, pos FROM o WHERE n >= 2),
 p AS (SELECT a.gene, a.i, abs(a.pos - b.pos) AS d FROM g a JOIN g b ON a.gene = b.gene AND a.i = b.i AND a.j < b.j),
 m AS (SELECT gene, i, CASE WHEN bool_or(d = 0) THEN exp(avg(ln(d + 1))) - 1 ELSE exp(avg(ln(CASE WHEN d = 0 THEN 1 ELSE d END))) END AS x FROM p GROUP BY gene, i)
 SELECT r.gene, round(r.x, 6) AS observed, round((1.0::DOUBLE + count(*) FILTER (m.x <= r.x + 1e-9 * greatest(1.0, r.x))) / (1.0::DOUBLE + count(*)), 9) AS p
 FROM m r JOIN m ON m.gene = r.gene AND m.i >= 0 WHERE r.i = -1 GROUP BY r.gene, r.x"""
)
def mc_pvalue(spark, sf_dir):
    """A simulated p-value for all of each gene's missense positions: as many sites as it has are drawn in each round, by the
    number of events at them, with numbers that SQL can make too."""
    v = _events(spark, sf_dir)
    sites = v.groupBy("gene", "pos").agg(F.count("*").cast("double").alias("w")).groupBy("gene").agg(F.sort_array(F.collect_list(F.struct("pos", "w"))).alias("s"))
    observed = counted_positions(usable_variants(v), "missense").where("n >= 2").select("gene", F.col("n").cast("int").alias("n"), mean_of_counted("pos", "counts").alias("observed"))
    tests = observed.join(sites, "gene").select(F.col("gene").alias("test_id"), "n", "observed", F.col("s.pos").alias("positions"), F.col("s.w").alias("weights"))
    found = p_values(tests, ROUNDS, most=ROUNDS + 1, repeatable=True)
    return found.join(observed, F.col("test_id") == F.col("gene")).select("gene", F.round("observed", 6).alias("observed"), F.round("p_value", 9).alias("p"))


@_query(
    """WITH p AS (SELECT user_id, (1.0::DOUBLE + count(*) FILTER (event_type = 'error')) / (1.0::DOUBLE + count(*)) AS a, (1.0::DOUBLE + count(*) FILTER (event_type = 'purchase')) / (1.0::DOUBLE + count(*)) AS b FROM events GROUP BY user_id)
 SELECT user_id, round(a * b * (1 - ln(a * b)), 9) AS p FROM p"""
)
def fisher_combine(spark, sf_dir):
    n = lambda kind: F.sum((F.col("event_type") == kind).cast("int"))
    p = _table(spark, sf_dir, "events").groupBy("user_id").agg(monte_carlo_p(n("error"), F.count("*")).alias("a"), monte_carlo_p(n("purchase"), F.count("*")).alias("b"))
    return p.select("user_id", F.round(fisher(F.array("a", F.lit(None).cast("double"), "b")), 9).alias("p"))


@_query("SELECT c_nationkey, c_mktsegment, CASE WHEN sum(c_acctbal) > 0 THEN round(log10(sum(c_acctbal)), 6) END AS rate FROM customer GROUP BY ALL")
def log10_rates(spark, sf_dir):
    return _table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.round(log10_or_null(F.sum("c_acctbal")), 6).alias("rate"))


@_query(
    """WITH g AS (SELECT l_suppkey, count(*) AS length, CASE WHEN l_suppkey % 7 <> 0 THEN sum(l_discount) END AS amount FROM lineitem GROUP BY l_suppkey)
 SELECT l_suppkey, CASE WHEN amount IS NOT NULL THEN round(log10(length::DOUBLE / sum(length) OVER () * sum(amount) OVER () * 1.25), 6) END AS frameshift FROM g"""
)
def share_allocation(spark, sf_dir):
    """A total apportioned by length; groups without an amount count for length alone."""
    g = _table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("length"), F.when(F.col("l_suppkey") % 7 != 0, F.sum("l_discount")).alias("amount"))
    return with_share(g, F.col("amount"), F.col("length"), "frameshift", 1.25).select("l_suppkey", F.round("frameshift", 6).alias("frameshift"))


@_query(
    """WITH c AS (SELECT string_split(text, '') AS c FROM documents WHERE length(text) >= 3), k AS (SELECT unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS kmer FROM c)
 SELECT kmer, count(*) AS n FROM k GROUP BY kmer"""
)
def kmer_count(spark, sf_dir):
    """Every 3-mer of the whole texts, counted by block of text before counts are shuffled."""
    return C.counted_kmers(_table(spark, sf_dir, "documents").where(F.length("text") >= 3), "text", 3)


@_query(
    """WITH k AS (SELECT p_brand, unnest(list_transform(range(1, length(p_type) - 1), lambda i: substr(p_type, i, 3))) AS kmer FROM part),
 r AS (SELECT kmer, count(*) AS n, count(*) / 1000.0::DOUBLE AS mu FROM k GROUP BY kmer HAVING count(*) % 2 = 0)
 SELECT p_brand, round(sum(coalesce(mu, 0)), 6) AS mu, count(*) AS n FROM k LEFT JOIN r ON k.kmer = r.kmer GROUP BY p_brand"""
)
def kmer_rate_join(spark, sf_dir):
    """Contexts meet their rates; an unknown one has rate 0."""
    k = _table(spark, sf_dir, "part").where(F.length("p_type") >= 3).select("p_brand", F.explode(F.transform(F.sequence(F.lit(1), F.length("p_type") - 2), lambda i: F.substring(F.col("p_type"), i, F.lit(3)))).alias("kmer"))
    r = k.groupBy("kmer").agg(F.count("*").alias("c")).where("c % 2 = 0").select("kmer", (F.col("c") / 1000.0).alias("mu"))
    return with_context_rates(k, r, ["kmer"]).groupBy("p_brand").agg(F.round(F.sum("mu"), 6).alias("mu"), F.count("*").alias("n"))


@_query(
    """WITH s AS (SELECT p_partkey, translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s, 2 + p_partkey % 29 AS bp FROM part)
 SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN substr(s, bp - 1, 3) ELSE translate(reverse(substr(s, bp - 1, 3)), 'ACGT', 'TGCA') END AS kmer FROM s"""
)
def centered_context(spark, sf_dir):
    """Three bases around a position, read along the strand."""
    p = _table(spark, sf_dir, "part").select("p_partkey", _bases("p_partkey", 1).alias("s"), (2 + F.col("p_partkey") % 29).cast("int").alias("bp"), F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-").alias("strand"))
    return p.select("p_partkey", C.centred_kmer(F.col("bp"), F.col("s"), F.lit(1), F.lit(0), F.col("strand"), 3).alias("kmer"))


def _bases(key: str, parts: int):
    """32 bases a part, from md5 of a key (and of the key with a number)."""
    texts = [F.col(key).cast("string"), *[F.concat_ws("|", F.col(key).cast("string"), F.lit(i)) for i in range(1, parts)]]
    return F.translate(F.concat(*[F.md5(t.cast("binary")) for t in texts]), "0123456789abcdef", "ACGTACGTACGTACGT")


_CODE_SQL = "substr('" + C.AMINO_ACIDS + "', (strpos('TCAG', substr({0}, 1, 1)) - 1) * 16 + (strpos('TCAG', substr({0}, 2, 1)) - 1) * 4 + strpos('TCAG', substr({0}, 3, 1)), 1)"


@_query(
    f"""WITH c AS (SELECT p_partkey, substr(translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 3) AS codon, p_partkey % 3 AS site, p_size % 5 - 2 AS off, p_size % 12 AS dist FROM part),
 a AS (SELECT *, unnest(['A', 'C', 'G', 'T']) AS base FROM c),
 m AS (SELECT *, {_CODE_SQL.format("codon")} AS aa, {_CODE_SQL.format("(substr(codon, 1, site) || base || substr(codon, site + 2))")} AS new FROM a WHERE substr(codon, site + 1, 1) <> base)
 SELECT p_partkey, base, CASE WHEN aa <> '*' AND new = '*' THEN 'nonsense' WHEN off <> 0 AND dist < 3 THEN 'splice_lof' WHEN aa <> new THEN 'missense'
 WHEN off = 0 AND dist < 4 THEN 'splice_region' WHEN off = 0 THEN 'synonymous' WHEN dist < 9 THEN 'splice_region' ELSE 'intronic' END AS consequence FROM m"""
)
def alt_explode_classify(spark, sf_dir):
    """The three changes of a codon's base, translated and classified."""
    p = _table(spark, sf_dir, "part").select("p_partkey", F.substring(_bases("p_partkey", 1), 1, 3).alias("codon"), (F.col("p_partkey") % 3).cast("int").alias("at"), (F.col("p_size") % 5 - 2).alias("off"), (F.col("p_size") % 12).alias("dist"))
    p = p.withColumn("base", F.explode(F.array(*map(F.lit, C.BASES)))).where(F.substring(F.col("codon"), F.col("at") + 1, F.lit(1)) != F.col("base"))
    new = C.amino_acid(C.changed(F.col("codon"), F.col("base"), F.col("at")))
    return p.select("p_partkey", "base", C.consequence(C.amino_acid(F.col("codon")), new, F.col("off"), F.col("dist")).alias("consequence"))


@_query(
    """WITH e AS (SELECT vec_id, label, vec_id // 20 AS block, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings WHERE embedding IS NOT NULL),
 p AS (SELECT a.label, a.block, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM e a JOIN e b ON a.label = b.label AND a.block = b.block AND a.vec_id < b.vec_id)
 SELECT label, block, count(*) AS n, round(exp(avg(ln(d))), 6) AS dist FROM p GROUP BY label, block"""
)
def structure_distance(spark, sf_dir):
    """Geometric means of distances in three dimensions, in small groups of points."""
    e = _table(spark, sf_dir, "embeddings").where("embedding is not null")
    point = F.struct(*[F.element_at("embedding", i).cast("double").alias(c) for i, c in enumerate("xyz", 1)])
    g = e.groupBy("label", F.floor(F.col("vec_id") / 20).alias("block")).agg(F.sort_array(F.collect_list(point)).alias("points"))
    n = F.size("points").cast("long")
    every = F.sequence(F.lit(0), F.size("points") - 1)
    dist = mean_of_counted_3d(every, F.transform(every, lambda _: F.lit(1).cast("long")), "points.x", "points.y", "points.z")
    return g.where(n > 1).select("label", "block", F.floor(n * (n - 1) / 2).alias("n"), F.round(dist, 6).alias("dist"))


@_query(
    """WITH c AS (SELECT CAST(c_nationkey AS VARCHAR) AS gene, c_mktsegment || '|' || c_custkey % 50 AS tx, count(*) AS n, CAST(max(c_custkey) % 10 AS BIGINT) AS len FROM customer GROUP BY ALL)
 SELECT gene, tx, n, len FROM (SELECT *, rank() OVER (PARTITION BY gene ORDER BY n DESC, len DESC) AS r FROM c) WHERE r = 1"""
)
def top_transcript(spark, sf_dir):
    """The transcripts of most variants and then of greatest length, ties included."""
    c = _table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("gene"), F.concat_ws("|", "c_mktsegment", F.col("c_custkey") % 50).alias("tx")).agg(F.count("*").alias("n"), (F.max("c_custkey") % 10).alias("len"))
    return most_held(c).select("gene", "tx", "n", "len")


_COVER_SQL = """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS gene, event_type AS tx, CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS INTEGER) AS tx_rank, CAST(day(ts) AS INTEGER) AS day FROM events WHERE user_id IS NOT NULL),
 h AS (SELECT gene, tx, tx_rank, CAST(count(*) AS INTEGER) AS len, list_sort(list(DISTINCT day)) AS days FROM e GROUP BY ALL),
 l AS (SELECT gene, list_sort(list(DISTINCT day)) AS days FROM e GROUP BY gene),
 r AS (SELECT 0 AS round, gene, CAST(NULL AS VARCHAR) AS tx, 0 AS n, days AS rest FROM l
  UNION ALL SELECT round + 1, gene, tx, n, list_filter(rest, lambda d: NOT list_contains(first_days, d)) FROM (
   SELECT round, gene, tx, n, rest, first(days) OVER (PARTITION BY gene ORDER BY tx_rank) AS first_days FROM (
    SELECT q.round, q.gene, h.tx, h.tx_rank, h.days, q.rest, len(list_intersect(h.days, q.rest)) AS n, rank() OVER (PARTITION BY q.gene ORDER BY len(list_intersect(h.days, q.rest)) DESC, h.len DESC) AS place
    FROM (SELECT DISTINCT round, gene, rest FROM r WHERE len(rest) > 0) q JOIN h ON h.gene = q.gene) WHERE place = 1 AND n > 0)),
 c AS (SELECT gene, tx, CAST(arg_max(n, round) AS INTEGER) AS n FROM r WHERE tx IS NOT NULL GROUP BY gene, tx),
 o AS (SELECT c.gene, c.tx, h.tx_rank, h.len, c.n, h.days, list(h.days) OVER (PARTITION BY c.gene ORDER BY h.tx_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c JOIN h USING (gene, tx))
 SELECT gene, tx, tx_rank, len, n, array_to_string(list_filter(days, lambda d: NOT list_contains(coalesce(flatten(before), []), d)), ',') AS days FROM o"""


def _days(spark: SparkSession, sf_dir: str):
    """Event types as transcripts of a user (gene, tx, tx_rank, len, inside), and the days on which anything happened."""
    e = _table(spark, sf_dir, "events").where("user_id is not null").select(F.col("user_id").cast("string").alias("gene"), F.col("event_type").alias("tx"), F.dayofmonth("ts").alias("day"))
    own = e.groupBy("gene", "tx").agg(F.collect_set("day").alias("own"), F.count("*").cast("int").alias("len"))
    every = e.groupBy("gene").agg(F.sort_array(F.collect_set("day")).alias("pos"))
    places = every.withColumns({"missense": F.transform("pos", lambda _: F.lit(1).cast("long")), "nonsense": F.transform("pos", lambda _: F.lit(0).cast("long"))})
    held = own.join(places, "gene").withColumns({"tx_rank": F.array_position(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), F.col("tx")).cast("int"), "inside": F.transform("pos", lambda p: F.array_contains("own", p))})
    return held, places


@_query()
def greedy_transcript_cover(spark, sf_dir):
    """Event types as transcripts of a user, covering the days on which anything happened."""
    found = greedy_cover(*_days(spark, sf_dir))
    return found.select("gene", "tx", "tx_rank", "len", "n", F.col("pos").alias("missense"), F.array().cast("array<int>").alias("nonsense"))


@_query(_COVER_SQL)
def greedy_cover_days(spark, sf_dir):
    """The same with days as text."""
    return greedy_cover(*_days(spark, sf_dir)).select("gene", "tx", "tx_rank", "len", "n", F.array_join(F.col("pos").cast("array<string>"), ",").alias("days"))


@_query(
    """SELECT user_id, event_id, CAST(hour(ts) AS INTEGER) AS h FROM events e WHERE event_type = 'error' AND NOT EXISTS
 (SELECT 1 FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'purchase' AND hour(c.ts) = hour(e.ts))"""
)
def leftover_anti(spark, sf_dir):
    """Variants at positions that nothing has consumed; repeats go or stay together."""
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.hour("ts").alias("h"))
    return left_over(e.where("event_type = 'error'"), e.where("event_type = 'purchase'"), ["user_id", "h"]).select("user_id", "event_id", "h")


@_query(
    """WITH x AS (SELECT o_custkey, CAST(datediff('day', DATE '1990-01-01', o_orderdate::DATE) AS INTEGER) AS s, CAST(datediff('day', DATE '1990-01-01', o_orderdate::DATE) AS INTEGER) + 20 AS e FROM orders),
 m AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x),
 g AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
 SELECT o_custkey, min(s) AS s, max(e) AS e FROM g GROUP BY o_custkey, k"""
)
def interval_union(spark, sf_dir):
    """Intervals of one key joined where they overlap or touch. As in the SQL, orders without a date join the last interval of
    their customer, and stand alone, without borders, where it has none."""
    day = F.datediff("o_orderdate", F.lit("1990-01-01"))
    rows = _table(spark, sf_dir, "orders").select("o_custkey", day.alias("s"), (day + 20).alias("e"))
    undated = rows.groupBy("o_custkey").agg(F.count("s").alias("dated"), F.count("*").alias("n")).where("dated = 0")
    alone = undated.select("o_custkey", F.explode(F.array_repeat(F.lit(None).cast("int"), F.col("n").cast("int"))).alias("s"))
    return joined_intervals(rows, "o_custkey").unionByName(alone.withColumn("e", F.col("s")))


@_query(
    """WITH e AS (SELECT user_id, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS r, day(ts) * 24 + hour(ts) AS bp, value FROM events),
 m AS (SELECT user_id, bp + d AS bp, min(r) AS first FROM e, (SELECT unnest([0, 1]) AS d) GROUP BY ALL)
 SELECT e.user_id, count(*) AS n, round(sum(value), 4) AS mu FROM e LEFT JOIN m ON m.user_id = e.user_id AND m.bp = e.bp WHERE first IS NULL OR first >= r GROUP BY e.user_id"""
)
def masked_sum(spark, sf_dir):
    """Rates summed over transcripts, less the sites that an earlier one codes for."""
    rank = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(("error", "purchase", "click", "view", "signup")) for x in (k, i)]), F.col("event_type"))
    e = _table(spark, sf_dir, "events").select("user_id", F.col("user_id").alias("gene"), rank.alias("tx_rank"), (F.dayofmonth("ts") * 24 + F.hour("ts")).alias("bp"), "value")
    spans = joined_intervals(e.select(F.struct("gene", "tx_rank").alias("k"), F.col("bp").alias("s"), (F.col("bp") + 1).alias("e")), "k")
    own = spans.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("cds")).select("k.gene", "k.tx_rank", "cds")
    return unmasked(e, own).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("mu"))


@_query("SELECT conv_id, count(*) AS n, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AND count(DISTINCT role) <= 3 AS valid FROM conversations GROUP BY conv_id")
def valid_structure(spark, sf_dir):
    """Whether a structure's residues run from its first number without a gap or a repeat, in few chains."""
    g = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"), F.size(F.collect_set("role")).alias("chains"))
    return g.select("conv_id", F.size("turns").cast("long").alias("n"), (without_gap(F.col("turns"), 0) & (F.col("chains") <= 3)).alias("valid"))


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@_query("SELECT c_nationkey, " + ", ".join(f"round(sum(c_acctbal) FILTER (c_mktsegment = '{s}'), 4) AS {s.lower()}_rate" for s in SEGMENTS) + " FROM customer GROUP BY c_nationkey")
def gene_rates_pivot(spark, sf_dir):
    """One row per gene, a column of summed rates per class."""
    p = rates_by_class(_table(spark, sf_dir, "customer").withColumnRenamed("c_acctbal", "mu"), "c_nationkey", "c_mktsegment", list(SEGMENTS))
    return p.select("c_nationkey", *[F.round(s, 4).alias(f"{s.lower()}_rate") for s in SEGMENTS])


@_query(
    EVENTS_SQL
    + """, c AS (SELECT unnest(['missense', 'nonsense']) AS mutation_category), g AS (SELECT DISTINCT gene FROM v WHERE event_type <> 'signup'),
 n AS (SELECT gene, cls, count(*) AS events_n, string_agg(printf('%.1f', pos / 2.0), ',' ORDER BY pos) AS dist FROM v WHERE cls IS NOT NULL GROUP BY gene, cls)
 SELECT g.gene AS gene_id, mutation_category, CAST(coalesce(events_n, 0) AS INTEGER) AS events_n, coalesce(dist, '') AS dist FROM g CROSS JOIN c LEFT JOIN n ON n.gene = g.gene AND n.cls = mutation_category"""
)
def result_long(spark, sf_dir):
    """Two rows a gene, distances as text with one digit, joined in order."""
    pair = F.array(*[F.struct(F.lit(c).alias("c"), repeated(F.col("pos"), F.col(c)).alias("p")) for c in ("missense", "nonsense")])
    rows = grouped_variants(_variants(spark, sf_dir)).select("gene", F.explode(pair).alias("x"))
    text = F.array_join(F.transform("x.p", lambda p: F.format_string("%.1f", p / 2.0)), ",")
    return rows.select(F.col("gene").alias("gene_id"), F.col("x.c").alias("mutation_category"), F.size("x.p").alias("events_n"), text.alias("dist"))


#: Users' made-up genes: SEQUENCE bases from 1 on, of which the coding ones are FIRST to LAST.
PARTS, FIRST, LAST = 10, 11, 310


def _user_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _table(spark, sf_dir, "events").select(F.col("user_id").alias("u")).distinct().where("u is not null")
    span = F.array(F.struct(F.lit(FIRST).alias("s"), F.lit(LAST).alias("e")))
    rows = users.select(F.col("u").cast("string").alias("gene"), F.concat(F.lit("T"), F.col("u").cast("string")).alias("tx"), F.lit(0).alias("tx_rank"), F.lit("1").alias("chrom"), F.lit(1).alias("start"), F.lit(32 * PARTS).alias("end"), F.lit("+").alias("strand"), span.alias("exons"), span.alias("cds"), _bases("u", PARTS).alias("gseq"), F.lit(0).alias("goffset"), F.lit(True).alias("canonical"))
    return rows.withColumn("cds_seq", F.substring("gseq", FIRST, LAST - FIRST + 1))


_RATES_SQL = "(VALUES " + ", ".join("('{}', '{}', {}::DOUBLE)".format(*x.split()) for x in TRINUCLEOTIDE_RATES.split("\n") if x) + ") r(kmer, kmer_to, mu)"
_SEQUENCE_SQL = " || ".join(["md5(CAST(u AS VARCHAR))", *[f"md5(u || '|{i}')" for i in range(1, PARTS)]])


_SITES_SQL = f"""WITH t AS (SELECT CAST(u AS VARCHAR) AS gene, translate({_SEQUENCE_SQL}, '0123456789abcdef', 'ACGTACGTACGTACGT') AS g FROM (SELECT DISTINCT user_id AS u FROM events WHERE user_id IS NOT NULL)),
 b AS (SELECT gene, g, unnest(range({FIRST}, {LAST + 1})) AS bp FROM t),
 c AS (SELECT gene, bp, substr(g, bp - 1, 3) AS kmer, substr(g, {FIRST} + (bp - {FIRST}) // 3 * 3, 3) AS codon, (bp - {FIRST}) % 3 AS site, least(bp - {FIRST}, {LAST} - bp) + 1 AS dist, unnest(['A', 'C', 'G', 'T']) AS base FROM b),
 a AS (SELECT gene, bp - {FIRST} AS pos, kmer, substr(kmer, 1, 1) || base || substr(kmer, 3, 1) AS kmer_to, dist, {_CODE_SQL.format("codon")} AS aa, {_CODE_SQL.format("(substr(codon, 1, site) || base || substr(codon, site + 2))")} AS new FROM c WHERE substr(kmer, 2, 1) <> base),
 q AS (SELECT gene, pos, coalesce(mu, 0) AS mu, CASE WHEN aa <> '*' AND new = '*' THEN 'nonsense' WHEN aa <> new THEN 'missense' WHEN dist < 4 THEN 'splice_region' ELSE 'synonymous' END AS consequence FROM a LEFT JOIN {_RATES_SQL} ON a.kmer = r.kmer AND a.kmer_to = r.kmer_to)"""


@_query(
    _SITES_SQL
    + """ SELECT gene, consequence, count(*) AS n, round(log10(sum(mu)), 6) AS rate FROM q GROUP BY gene, consequence
 UNION ALL SELECT gene, 'loss_of_function', count(*), round(log10(sum(mu)), 6) FROM q WHERE consequence = 'nonsense' GROUP BY gene"""
)
def site_rates(spark, sf_dir):
    """Every single-base change of each gene, classified, with its context's rate, summed by class."""
    sums = class_sums(_user_transcripts(spark, sf_dir), read_context_rates(spark))
    return sums.select("gene", "consequence", "n", F.round(log10_or_null(F.col("mu")), 6).alias("rate"))


_RATE_COLUMNS = ("missense_rate", "nonsense_rate", "splice_lof_rate", "splice_region_rate", "synonymous_rate", "frameshift_rate")


@_query(
    _SITES_SQL
    + f""", p AS (SELECT gene, {", ".join(f"log10(sum(mu) FILTER (consequence = '{c.removesuffix('_rate')}')) AS {c}" for c in _RATE_COLUMNS[:5])}, sum(mu) FILTER (consequence = 'nonsense') AS burden FROM q GROUP BY gene)
 SELECT gene AS transcript_id, '1' AS chrom, {LAST - FIRST} AS length, {", ".join(f"round({c}, 6) AS {c}" for c in _RATE_COLUMNS[:5])},
 CASE WHEN burden IS NOT NULL THEN round(log10({LAST - FIRST} / (sum({LAST - FIRST}) OVER ())::DOUBLE * sum(burden) OVER () * 1.25), 6) END AS frameshift_rate FROM p"""
)
def gene_rates_users(spark, sf_dir):
    """The rates job on users' genes."""
    transcripts = _user_transcripts(spark, sf_dir)
    out = gene_rates(transcripts.select(F.col("gene").alias("symbol"), F.col("tx").alias("transcript_id")), transcripts, read_context_rates(spark))
    return out.select("transcript_id", "chrom", "length", *[F.round(c, 6).alias(c) for c in _RATE_COLUMNS])


def _user_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variants(spark, sf_dir).withColumn("pos", F.lit(FIRST) + F.col("pos") % (LAST - FIRST + 1))


@_query(
    EVENTS_SQL
    + f""", e AS (SELECT gene, cls, pos % {LAST - FIRST + 1} AS pos, row_number() OVER (PARTITION BY gene, cls ORDER BY event_id) AS k FROM v WHERE cls IS NOT NULL),
 t AS (SELECT gene FROM e GROUP BY gene HAVING count(*) >= 2), c AS (SELECT unnest(['missense', 'nonsense']) AS cls),
 n AS (SELECT gene, cls, CAST(count(*) AS INTEGER) AS events_n FROM e GROUP BY gene, cls),
 p AS (SELECT a.gene, a.cls, abs(a.pos - b.pos) AS d FROM e a JOIN e b ON a.gene = b.gene AND a.cls = b.cls AND a.k < b.k),
 m AS (SELECT gene, cls, CASE WHEN bool_or(d = 0) THEN exp(avg(ln(d + 1))) - 1 ELSE exp(avg(ln(CASE WHEN d = 0 THEN 1 ELSE d END))) END AS x FROM p GROUP BY gene, cls)
 SELECT t.gene AS gene_id, c.cls AS mutation_category, coalesce(events_n, 0) AS events_n, coalesce(printf('%.1f', x), 'nan') AS dist FROM t CROSS JOIN c LEFT JOIN n ON n.gene = t.gene AND n.cls = c.cls LEFT JOIN m ON m.gene = t.gene AND m.cls = c.cls"""
)
def cluster_observed_users(spark, sf_dir):
    """The clustering job up to its simulations: users' events as variants of their genes, at the coding position of the minute."""
    return observed_clustering(_user_variants(spark, sf_dir), _user_transcripts(spark, sf_dir))


@_query()
def cluster_users(spark, sf_dir):
    """The clustering job as a whole, with as many simulations as it has by default: a million for each test, and up to a hundred
    million for those that these do not decide."""
    found = cluster(_user_variants(spark, sf_dir), _user_transcripts(spark, sf_dir), read_context_rates(spark))
    return found.select("gene_id", "mutation_category", "events_n", "dist", F.round("probability", 9).alias("probability"))


SEEDED = 300


@_query(
    _SITES_SQL
    + f""", v AS (SELECT CAST(user_id AS VARCHAR) AS gene, (CAST(hour(ts) * 60 + minute(ts) AS INTEGER)) % {LAST - FIRST + 1} AS pos, CASE event_type WHEN 'error' THEN 'missense' ELSE 'nonsense' END AS cls, row_number() OVER () AS k FROM events WHERE event_type IN ('error', 'purchase')),
 e AS (SELECT gene, cls, pos, row_number() OVER (PARTITION BY gene, cls ORDER BY k) AS j FROM v), tested AS (SELECT gene FROM e GROUP BY gene HAVING count(*) >= 2),
 n AS (SELECT gene, cls, count(*) AS n FROM e GROUP BY gene, cls),
 s AS (SELECT gene, consequence AS cls, pos, sum(sum(mu)) OVER (PARTITION BY gene, consequence ORDER BY pos) AS cum, sum(sum(mu)) OVER (PARTITION BY gene, consequence) AS total FROM q WHERE consequence IN ('missense', 'nonsense') GROUP BY gene, consequence, pos),
 d AS (SELECT n.gene, n.cls, i, j, {_UNIFORM_SQL.format("n.gene || '|T' || n.gene || '|' || n.cls || '|' || i || '|' || j")} AS u FROM n, (SELECT unnest(range({SEEDED})) AS i), LATERAL (SELECT unnest(range(n.n)) AS j) WHERE n.n >= 2),
 x AS (SELECT d.gene, d.cls, i, j, s.pos FROM (SELECT d.*, u * total AS w FROM d JOIN (SELECT DISTINCT gene, cls, total FROM s) m USING (gene, cls)) d ASOF JOIN s ON s.gene = d.gene AND s.cls = d.cls AND d.w <= s.cum
  UNION ALL SELECT gene, cls, -1, j, pos FROM e),
 p AS (SELECT a.gene, a.cls, a.i, abs(a.pos - b.pos) AS d FROM x a JOIN x b ON a.gene = b.gene AND a.cls = b.cls AND a.i = b.i AND a.j < b.j),
 m AS (SELECT gene, cls, i, CASE WHEN bool_or(d = 0) THEN exp(avg(ln(d + 1))) - 1 ELSE exp(avg(ln(CASE WHEN d = 0 THEN 1 ELSE d END))) END AS x FROM p GROUP BY gene, cls, i),
 y AS (SELECT r.gene, r.cls, r.x, (1.0::DOUBLE + count(*) FILTER (m.x <= r.x + 1e-9 * greatest(1.0, r.x))) / (1.0::DOUBLE + {SEEDED}) AS probability FROM m r LEFT JOIN m ON m.gene = r.gene AND m.cls = r.cls AND m.i >= 0 WHERE r.i = -1 GROUP BY r.gene, r.cls, r.x)
 SELECT tested.gene AS gene_id, c.cls AS mutation_category, CAST(coalesce(n.n, 0) AS INTEGER) AS events_n, coalesce(printf('%.1f', x), 'nan') AS dist, round(probability, 9) AS probability
 FROM tested CROSS JOIN (SELECT unnest(['missense', 'nonsense']) AS cls) c LEFT JOIN n ON n.gene = tested.gene AND n.cls = c.cls LEFT JOIN y ON y.gene = tested.gene AND y.cls = c.cls"""
)
def cluster_seeded_users(spark, sf_dir):
    """The clustering job with its simulations, few enough and drawn by numbers that SQL can repeat."""
    found = cluster(_user_variants(spark, sf_dir), _user_transcripts(spark, sf_dir), read_context_rates(spark), iterations=SEEDED, most=SEEDED + 1, repeatable=True)
    return found.select("gene_id", "mutation_category", "events_n", "dist", F.round("probability", 9).alias("probability"))


@_query(EVENTS_SQL + " SELECT gene FROM v WHERE event_type = 'error' GROUP BY gene HAVING count(*) > 1")
def batch_gate(spark, sf_dir):
    """Genes that make a batch."""
    return many_missense(_events(spark, sf_dir))


#: Two made-up transcripts a user, (exons, coding intervals), on a strand by the user's number: the second has another intron, and
#: shares some of the first one's coding bases in another frame.
SPLICED = ((((1, 120), (161, 310)), ((11, 120), (161, 290))), (((1, 100), (141, 310)), ((21, 100), (141, 291))))


def _spliced_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = lambda x: F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e in x])
    models = F.explode(F.array(*[F.struct(F.lit(i).alias("tx_rank"), spans(exons).alias("exons"), spans(cds).alias("cds")) for i, (exons, cds) in enumerate(SPLICED)]))
    users = _table(spark, sf_dir, "events").select(F.col("user_id").alias("u")).distinct().where("u is not null")
    rows = users.select("u", _bases("u", PARTS).alias("gseq"), F.when(F.col("u") % 2 == 0, "+").otherwise("-").alias("strand"), models.alias("m")).select("u", "gseq", "strand", "m.*")
    plus = F.array_join(F.transform("cds", lambda x: F.substring(F.col("gseq"), x["s"], x["e"] - x["s"] + 1)), "")
    rows = rows.withColumn("cds_seq", F.when(F.col("strand") == "-", C.reverse_complement(plus)).otherwise(plus))
    return rows.select(F.col("u").cast("string").alias("gene"), F.concat(F.lit("T"), F.col("u").cast("string"), F.lit("-"), F.col("tx_rank").cast("string")).alias("tx"), "tx_rank", F.lit("1").alias("chrom"), F.lit(1).alias("start"), F.lit(310).alias("end"), "strand", "exons", "cds", "cds_seq", "gseq", F.lit(0).alias("goffset"), (F.col("tx_rank") == 0).alias("canonical"))


def _spliced_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variants(spark, sf_dir).withColumn("pos", F.lit(1) + F.col("pos") % 315)


_FLIP_SQL = "translate(reverse({0}), 'ACGT', 'TGCA')"
#: Geometry of each base of both transcripts and strands.
_PLACES_SQL = f"""WITH x AS (SELECT * FROM (VALUES {", ".join(f"({i}, {s}, {e}, {cs}, {ce})" for i, (exons, cds) in enumerate(SPLICED) for (s, e), (cs, ce) in zip(exons, cds))}) v(tx_rank, s, e, cs, ce)),
 y AS (SELECT tx_rank, min(cs) AS low, max(ce) AS high FROM x GROUP BY tx_rank), z AS (SELECT y.*, strand, CASE strand WHEN '-' THEN high ELSE low END AS first FROM y, (SELECT unnest(['+', '-']) AS strand)),
 near AS (SELECT z.*, bp, s, e, CASE WHEN bp BETWEEN s AND e THEN 0 ELSE least(abs(s - bp), abs(e - bp)) END AS gap, bp BETWEEN cs AND ce AS own FROM z JOIN x USING (tx_rank), (SELECT unnest(range(1, 321)) AS bp)),
 place AS (SELECT *, bool_or(own) OVER (PARTITION BY tx_rank, strand, bp) AS coding, greatest(s, least(e, bp)) AS snap FROM near QUALIFY row_number() OVER (PARTITION BY tx_rank, strand, bp ORDER BY gap, s) = 1),
 ranks AS (SELECT tx_rank, upto, CAST(sum(greatest(0, least(e, upto) - s + 1)) AS INTEGER) AS r FROM x, (SELECT unnest(range(1, 321)) AS upto) GROUP BY tx_rank, upto),
 geo AS (SELECT p.tx_rank, p.strand, p.bp, p.gap, coding, low, high, least(abs(s - bp), abs(e - bp)) + CASE WHEN coding THEN 1 ELSE 0 END AS boundary, CASE p.strand WHEN '-' THEN -1 ELSE 1 END * (bp - snap) AS off,
 CASE p.strand WHEN '-' THEN -1 ELSE 1 END * (i.r - j.r) AS pos FROM place p JOIN ranks i ON i.tx_rank = p.tx_rank AND i.upto = p.snap JOIN ranks j ON j.tx_rank = p.tx_rank AND j.upto = p.first),
 size AS (SELECT tx_rank, CAST(sum(ce - cs + 1) AS INTEGER) AS len FROM x GROUP BY tx_rank)"""
_SPLICED_SQL = (
    _PLACES_SQL
    + f""", t AS (SELECT u, CAST(u AS VARCHAR) AS gene, CASE WHEN u % 2 = 0 THEN '+' ELSE '-' END AS strand, translate({_SEQUENCE_SQL}, '0123456789abcdef', 'ACGTACGTACGTACGT') AS g FROM (SELECT DISTINCT user_id AS u FROM events WHERE user_id IS NOT NULL)),
 seqs AS (SELECT gene, strand, tx_rank, g, string_agg(substr(g, cs, ce - cs + 1), '' ORDER BY cs) AS plus FROM t, x GROUP BY ALL),
 cds AS (SELECT *, CASE strand WHEN '-' THEN {_FLIP_SQL.format("plus")} ELSE plus END AS cds FROM seqs),
 b AS (SELECT gene, geo.*, CASE geo.strand WHEN '-' THEN {_FLIP_SQL.format("substr(g, bp - 1, 3)")} ELSE substr(g, bp - 1, 3) END AS kmer, CASE WHEN coding THEN substr(cds, pos // 3 * 3 + 1, 3) END AS codon, unnest(['A', 'C', 'G', 'T']) AS base FROM cds JOIN geo USING (tx_rank, strand) WHERE bp BETWEEN low AND high AND gap <= 9),
 a AS (SELECT *, substr(kmer, 1, 1) || base || substr(kmer, 3, 1) AS kmer_to, coalesce({_CODE_SQL.format("codon")}, '0') AS aa, coalesce({_CODE_SQL.format("(substr(codon, 1, pos % 3) || base || substr(codon, pos % 3 + 2))")}, '0') AS new FROM b WHERE substr(kmer, 2, 1) <> base),
 q AS (SELECT gene, tx_rank, bp, coalesce(mu, 0) AS mu, CASE WHEN aa <> '*' AND new = '*' THEN 'nonsense' WHEN off <> 0 AND boundary < 3 THEN 'splice_lof' WHEN aa <> new THEN 'missense' WHEN off = 0 AND boundary < 4 THEN 'splice_region' WHEN off = 0 THEN 'synonymous' WHEN boundary < 9 THEN 'splice_region' ELSE 'intronic' END AS consequence
 FROM a LEFT JOIN {_RATES_SQL} ON a.kmer = r.kmer AND a.kmer_to = r.kmer_to)"""
)


@_query(
    _SPLICED_SQL
    + """ SELECT gene, 'T' || gene || '-' || tx_rank AS tx, consequence, count(*) AS n, round(log10(sum(mu)), 6) AS rate FROM (SELECT * FROM q WHERE consequence <> 'intronic' UNION ALL SELECT gene, tx_rank, bp, mu, 'loss_of_function' FROM q WHERE consequence IN ('nonsense', 'splice_lof')) GROUP BY gene, tx_rank, consequence"""
)
def site_rates_spliced(spark, sf_dir):
    """Changes and rates by class in transcripts with introns, on both strands."""
    sums = class_sums(_spliced_transcripts(spark, sf_dir), read_context_rates(spark), by=("gene", "tx"))
    return sums.select("gene", "tx", "consequence", "n", F.round(log10_or_null(F.col("mu")), 6).alias("rate"))


_UNION_LENGTH = 260


@_query(
    _SPLICED_SQL
    + f""", w AS (SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.tx_rank < q.tx_rank AND q.bp BETWEEN x.cs AND x.ce)),
 p AS (SELECT gene, {", ".join(f"log10(sum(mu) FILTER (consequence = '{c.removesuffix('_rate')}')) AS {c}" for c in _RATE_COLUMNS[:5])}, sum(mu) FILTER (consequence = 'nonsense') AS burden FROM w GROUP BY gene)
 SELECT gene AS transcript_id, '1' AS chrom, {_UNION_LENGTH} AS length, {", ".join(f"round({c}, 6) AS {c}" for c in _RATE_COLUMNS[:5])},
 CASE WHEN burden IS NOT NULL THEN round(log10({_UNION_LENGTH} / (sum({_UNION_LENGTH}) OVER ())::DOUBLE * sum(burden) OVER () * 1.25), 6) END AS frameshift_rate FROM p"""
)
def gene_rates_spliced(spark, sf_dir):
    """The rates job on genes of two transcripts: bases that the first one codes for count once, shared splice sites twice."""
    transcripts = _spliced_transcripts(spark, sf_dir)
    out = gene_rates(transcripts.select(F.col("gene").alias("symbol"), F.col("tx").alias("transcript_id")), transcripts, read_context_rates(spark))
    return out.select("transcript_id", "chrom", "length", *[F.round(c, 6).alias(c) for c in _RATE_COLUMNS])


_HELD_SQL = (
    _PLACES_SQL
    + """, v AS (SELECT user_id AS u, CAST(user_id AS VARCHAR) AS gene, event_id AS k, 1 + CAST(hour(ts) * 60 + minute(ts) AS INTEGER) % 315 AS bp, CASE event_type WHEN 'error' THEN 'missense' WHEN 'purchase' THEN 'nonsense' END AS cls FROM events WHERE event_type <> 'signup' AND user_id IS NOT NULL),
 c AS (SELECT gene, u, size.* FROM (SELECT DISTINCT gene, u FROM v), size),
 h AS (SELECT v.gene, geo.tx_rank, k, cls, pos, len FROM v JOIN geo ON geo.bp = v.bp AND geo.strand = CASE WHEN u % 2 = 0 THEN '+' ELSE '-' END JOIN size USING (tx_rank) WHERE cls IS NOT NULL AND pos >= 0 AND pos < len AND (coding OR abs(off) < 9)),
 n AS (SELECT c.gene, c.tx_rank, c.len, CAST(count(h.k) AS INTEGER) AS n FROM c LEFT JOIN h ON h.gene = c.gene AND h.tx_rank = c.tx_rank GROUP BY ALL)"""
)


@_query(_HELD_SQL + " SELECT gene AS hgnc_symbol, 'T' || gene || '-' || tx_rank AS transcript_id, len AS length, n AS de_novos FROM n")
def transcripts_spliced(spark, sf_dir):
    """The transcripts job: how many of a gene's variants lie in each of its transcripts, or in the splice regions beside their exons."""
    return transcripts_with_variants(_spliced_variants(spark, sf_dir), _spliced_transcripts(spark, sf_dir))


_CHOSEN_SQL = (
    _HELD_SQL
    + """, best AS (SELECT gene, tx_rank, n FROM n WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY gene ORDER BY n DESC, len DESC) = 1),
 more AS (SELECT h.gene, h.tx_rank, CAST(count(*) AS INTEGER) AS n FROM h JOIN best b ON b.gene = h.gene AND b.tx_rank <> h.tx_rank WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.gene = h.gene AND o.k = h.k AND o.tx_rank = b.tx_rank) GROUP BY h.gene, h.tx_rank),
 chosen AS (FROM best UNION ALL FROM more)"""
)


@_query(_CHOSEN_SQL + " SELECT gene AS hgnc_symbol, 'T' || gene || '-' || tx_rank AS transcript_id, len AS length, chosen.n AS de_novos FROM chosen JOIN size USING (tx_rank)")
def transcripts_spliced_minimal(spark, sf_dir):
    """The same for the small set that holds all variants."""
    return transcripts_with_variants(_spliced_variants(spark, sf_dir), _spliced_transcripts(spark, sf_dir), minimal=True)


@_query(
    _CHOSEN_SQL
    + """, e AS (SELECT h.* FROM h JOIN chosen USING (gene, tx_rank) WHERE NOT EXISTS (SELECT 1 FROM h o JOIN chosen b ON b.gene = o.gene AND b.tx_rank = o.tx_rank WHERE o.gene = h.gene AND o.k = h.k AND o.tx_rank < h.tx_rank)),
 p AS (SELECT a.gene, a.tx_rank, a.cls, abs(a.pos - b.pos) AS d FROM e a JOIN e b ON a.gene = b.gene AND a.tx_rank = b.tx_rank AND a.cls = b.cls AND a.k < b.k),
 m AS (SELECT gene, tx_rank, cls, CASE WHEN bool_or(d = 0) THEN exp(avg(ln(d + 1))) - 1 ELSE exp(avg(ln(CASE WHEN d = 0 THEN 1 ELSE d END))) END AS x FROM p GROUP BY ALL),
 tested AS (SELECT gene, CAST(count(*) FILTER (cls = 'missense') AS INTEGER) AS missense, CAST(count(*) FILTER (cls = 'nonsense') AS INTEGER) AS nonsense FROM v GROUP BY gene HAVING count(cls) >= 2),
 k AS (SELECT unnest(['missense', 'nonsense']) AS cls), d AS (SELECT gene, k.cls, string_agg(coalesce(printf('%.1f', x), 'nan'), ',' ORDER BY tx_rank) AS dist FROM chosen CROSS JOIN k LEFT JOIN m USING (gene, tx_rank, cls) GROUP BY ALL)
 SELECT t.gene AS gene_id, k.cls AS mutation_category, CASE k.cls WHEN 'missense' THEN missense ELSE nonsense END AS events_n, coalesce(dist, 'nan') AS dist FROM tested t CROSS JOIN k LEFT JOIN d ON d.gene = t.gene AND d.cls = k.cls"""
)
def cluster_observed_spliced(spark, sf_dir):
    """What the clustering job observes in a cover of two transcripts with introns, on both strands."""
    return observed_clustering(_spliced_variants(spark, sf_dir), _spliced_transcripts(spark, sf_dir))
