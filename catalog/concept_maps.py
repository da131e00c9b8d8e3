"""Resolving codes, climbing an ontology, rewriting events.

The ontology is customer -> (nation -> region, segment) -> WORLD; an order is an event coded by
its customer. Regions, some nations and some segments are tokens.
"""

from pyspark.sql import functions as F

from catalog.base import CODED, coded_events, query, table, with_sql
from tidemark.functions import fixed_values as fixed
from tidemark.operators import concepts
from tidemark.session import cut_lineage


def _named(prefix, column):
    return F.concat(F.lit(prefix + "/"), F.col(column).cast("string"))


def closure(spark, sf_dir):
    """``code, ancestor``: every code with itself and all its ancestors."""
    nation = table(spark, sf_dir, "nation").select(
        _named("NATION", "n_nationkey").alias("nation"), _named("REGION", "n_regionkey").alias("region")
    )
    customer = table(spark, sf_dir, "customer").select(
        _named("CUST", "c_custkey").alias("code"),
        _named("NATION", "c_nationkey").alias("nation"),
        _named("SEG", "c_mktsegment").alias("segment"),
    )
    world = F.lit("WORLD")

    def chains(df, code, *above):
        chain = F.array_distinct(F.array(F.col(code), *above, world))
        return df.select(F.col(code).alias("code"), F.explode(chain).alias("ancestor"))

    def pairs(df, code, *above):
        return chains(df, code, *above).distinct()

    return (
        # A customer has one row. Looking for repeats would hold every pair of a file in one task.
        chains(customer.join(F.broadcast(nation), "nation"), "code", F.col("nation"), F.col("region"), F.col("segment"))
        .unionByName(pairs(nation, "nation", F.col("region")))
        .unionByName(pairs(nation, "region"))
        .unionByName(pairs(customer, "segment"))
        .unionByName(spark.createDataFrame([("WORLD", "WORLD")], "code string, ancestor string"))
    )


def tokens(spark, sf_dir):
    """``code, weight`` of the vocabulary."""
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    return (
        nation.select(_named("REGION", "n_regionkey").alias("code"), F.lit(-0.1).alias("weight")).distinct()
        .unionByName(
            nation.filter("n_regionkey < 3").select(
                _named("NATION", "n_nationkey").alias("code"),
                (-F.col("n_nationkey").cast("double") / 40).alias("weight"),
            )
        )
        .unionByName(
            customer.filter("c_mktsegment IN ('BUILDING', 'MACHINERY')").select(
                _named("SEG", "c_mktsegment").alias("code"), F.lit(-0.3).alias("weight")
            ).distinct()
        )
        .unionByName(
            customer.filter("c_acctbal > 9000").select(
                _named("CUST", "c_custkey").alias("code"), F.lit(-1.0).alias("weight")
            )
        )
    )


def order_events(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderdate").alias("time"),
        F.when(F.col("o_orderpriority") != "5-LOW", _named("CUST", "o_custkey")).alias("code"),
        F.col("o_orderkey").alias("ordinal"),
    )


def metadata(spark, sf_dir):
    """Crosswalk: rich customers name their nation and segment, some name nothing."""
    named = F.array(_named("NATION", "c_nationkey"), _named("SEG", "c_mktsegment"))
    return table(spark, sf_dir, "customer").filter("c_acctbal > 4000").select(
        _named("CUST", "c_custkey").alias("code"),
        F.when(F.col("c_acctbal") > 5000, named).alias("parent_codes"),
    )


def concept_table(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("concept_id"),
        F.lit("CUST").alias("vocabulary_id"),
        F.col("c_custkey").cast("string").alias("concept_code"),
        F.col("c_name").alias("concept_name"),
    )
    nation = table(spark, sf_dir, "nation").select(
        (F.lit(-1) - F.col("n_nationkey")).cast("string").alias("concept_id"),
        F.lit("NATION").alias("vocabulary_id"),
        F.col("n_nationkey").cast("string").alias("concept_code"),
        F.col("n_name").alias("concept_name"),
    )
    return customer.unionByName(nation)


def relationship_table(spark, sf_dir):
    """Customers map to their nation, some to themselves too; some edges are invalid."""
    edge = table(spark, sf_dir, "customer").filter("c_acctbal BETWEEN 0 AND 4500")
    to_nation = edge.select(
        F.col("c_custkey").cast("string").alias("concept_id_1"),
        (F.lit(-1) - F.col("c_nationkey")).cast("string").alias("concept_id_2"),
        F.when(F.col("c_acctbal") < 3500, "Maps to").otherwise("Is a").alias("relationship_id"),
        F.when(F.col("c_acctbal") < 1000, "D").alias("invalid_reason"),
    )
    to_self = edge.filter("c_acctbal > 2000").select(
        F.col("c_custkey").cast("string").alias("concept_id_1"),
        F.col("c_custkey").cast("string").alias("concept_id_2"),
        F.lit("Maps to").alias("relationship_id"),
        F.lit(None).cast("string").alias("invalid_reason"),
    )
    return to_nation.unionByName(to_self)


# Names of the curated families in turn, and one that no family has.
_SPELLED = [f"{family}/{name}" for family, names in fixed.CURATED_FAMILIES.items() for name in names] + ["UNLISTED/NAME"]
_TARGETS = {f"{family}/{name}": target for family, names in fixed.CURATED_FAMILIES.items() for name, target in names.items()}


def _listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query("curated_codes", f"""
WITH spelled AS (SELECT {_listed(_SPELLED)}[o_custkey % {len(_SPELLED)} + 1] AS code FROM orders),
curated AS (SELECT unnest({_listed(_TARGETS)}) AS code, unnest({_listed(_TARGETS.values())}) AS target),
inventory AS (SELECT code, count(*) AS n_events FROM spelled GROUP BY code)
SELECT code, target, 'manual' AS method, n_events FROM inventory JOIN curated USING (code)
""")
def curated_codes(spark, sf_dir):
    """Orders as events whose codes are names of the curated families; what the mapping makes of them."""
    names = F.array(*[F.lit(name) for name in _SPELLED])
    spelled = table(spark, sf_dir, "orders").select(F.get(names, (F.col("o_custkey") % len(_SPELLED)).cast("int")).alias("code"))
    inventory = concepts.code_inventory(spelled).withColumnRenamed("count", "n_events")
    resolved = concepts.resolve_curated(inventory, concepts.curated_mapping(spark))
    return resolved.join(inventory, "code").select("code", "target", "method", "n_events")


def curated(spark, sf_dir):
    """By hand: customers of one segment to their region."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    return table(spark, sf_dir, "customer").filter("c_mktsegment = 'HOUSEHOLD'").join(
        F.broadcast(nation), "c_nationkey"
    ).select(_named("CUST", "c_custkey").alias("code"), _named("REGION", "n_regionkey").alias("target"))


_ONTOLOGY = """
cust AS (
  SELECT 'CUST/' || c_custkey AS code, 'NATION/' || c_nationkey AS nation, 'REGION/' || n_regionkey AS region,
         'SEG/' || c_mktsegment AS segment, c_acctbal, c_mktsegment, c_custkey, c_nationkey
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
closure AS (
  SELECT code, unnest([code, nation, region, segment, 'WORLD']) AS ancestor FROM cust
  UNION SELECT 'NATION/' || n_nationkey, unnest(['NATION/' || n_nationkey, 'REGION/' || n_regionkey, 'WORLD']) FROM nation
  UNION SELECT 'REGION/' || n_regionkey, unnest(['REGION/' || n_regionkey, 'WORLD']) FROM nation
  UNION SELECT segment, unnest([segment, 'WORLD']) FROM cust
  UNION SELECT 'WORLD', 'WORLD'),
edges AS (
  SELECT DISTINCT code, ancestor AS parent FROM closure c
  WHERE code <> ancestor AND NOT EXISTS (
    SELECT 1 FROM closure o JOIN closure b ON b.code = o.ancestor
    WHERE o.code = c.code AND o.ancestor <> c.code AND b.ancestor = c.ancestor AND b.code <> c.ancestor)),
tokens AS (
  SELECT DISTINCT 'REGION/' || n_regionkey AS code, -0.1::DOUBLE AS weight FROM nation
  UNION SELECT 'NATION/' || n_nationkey, -n_nationkey / 40.0::DOUBLE FROM nation WHERE n_regionkey < 3
  UNION SELECT segment, -0.3::DOUBLE FROM cust WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
  UNION SELECT code, -1.0::DOUBLE FROM cust WHERE c_acctbal > 9000)
"""

_CLIMB = """
walk(target, node, hops) AS (
  SELECT DISTINCT target, target, 0 FROM wanted
  UNION ALL
  SELECT w.target, e.parent, w.hops + 1 FROM walk w JOIN edges e ON e.code = w.node
  WHERE w.node NOT IN (SELECT code FROM tokens)),
climbed AS (
  SELECT target, arg_min(t.code, (w.hops, t.weight, t.code)) AS vocab_code,
         arg_min(w.hops, (w.hops, t.weight, t.code)) AS hops, arg_min(t.weight, (w.hops, t.weight, t.code)) AS weights
  FROM walk w JOIN tokens t ON t.code = w.node GROUP BY target)
"""

_RESOLVED = """
order_events AS (
  SELECT o_custkey AS subject_id, o_orderdate AS time, o_orderkey AS ordinal,
         CASE WHEN o_orderpriority <> '5-LOW' THEN 'CUST/' || o_custkey END AS code
  FROM orders),
inventory AS (SELECT code, count(*) AS count FROM order_events GROUP BY code),
codes AS (SELECT i.code, c.* EXCLUDE code FROM inventory i JOIN cust c USING (code)),
resolved AS (
  SELECT code, code AS target, 'direct' AS method FROM codes WHERE c_acctbal > 9000
  UNION ALL
  SELECT code, unnest([nation, segment]), 'sssom' FROM codes WHERE c_acctbal > 5000 AND c_acctbal <= 9000
  UNION ALL
  SELECT code, nation, 'maps_to' FROM codes WHERE c_acctbal >= 1000 AND c_acctbal < 3500
  UNION ALL
  SELECT code, code, 'maps_to' FROM codes WHERE c_acctbal > 2000 AND c_acctbal <= 4500
  UNION ALL
  SELECT code, region, 'manual' FROM codes
  WHERE c_mktsegment = 'HOUSEHOLD' AND NOT (c_acctbal >= 1000 AND c_acctbal <= 4500) AND c_acctbal <= 5000),
wanted AS (SELECT DISTINCT target FROM resolved)
"""

_MAP = """
concept_map AS (
  SELECT r.code, i.count, arg_min(r.target, (hops, weights, vocab_code, r.target)) AS target,
         arg_min(method, (hops, weights, vocab_code, r.target)) AS method,
         arg_min(vocab_code, (hops, weights, vocab_code, r.target)) AS vocab_code,
         min(hops) AS hops, arg_min(weights, (hops, weights, vocab_code, r.target)) AS weights
  FROM resolved r JOIN climbed USING (target) JOIN inventory i ON i.code = r.code GROUP BY ALL)
"""


def _recursive(*ctes):
    return with_sql(*ctes).replace("WITH ", "WITH RECURSIVE ", 1)


@query("code_inventory", with_sql(CODED) + "SELECT code, count(*) AS count FROM coded GROUP BY code")
def code_inventory(spark, sf_dir):
    return concepts.code_inventory(coded_events(spark, sf_dir))


@query("resolver_chain", with_sql(_ONTOLOGY, _RESOLVED) + "SELECT * FROM resolved")
def resolver_chain(spark, sf_dir):
    inventory = cut_lineage(concepts.code_inventory(order_events(spark, sf_dir)))
    return concepts.resolve_chain(
        inventory, tokens(spark, sf_dir), metadata(spark, sf_dir), concept_table(spark, sf_dir),
        relationship_table(spark, sf_dir), curated(spark, sf_dir),
    )


@query("bridge", with_sql(_ONTOLOGY) + """
SELECT code, nation AS target, 'maps_to' AS method FROM cust WHERE c_acctbal >= 1000 AND c_acctbal < 3500
UNION ALL
SELECT code, code, 'maps_to' FROM cust WHERE c_acctbal > 2000 AND c_acctbal <= 4500
""")
def bridge(spark, sf_dir):
    codes = table(spark, sf_dir, "customer").select(_named("CUST", "c_custkey").alias("code"))
    return concepts.resolve_bridge(codes, concept_table(spark, sf_dir), relationship_table(spark, sf_dir))


@query("crosswalk", with_sql(_ONTOLOGY) + """
SELECT code, unnest([nation, segment]) AS target, 'sssom' AS method FROM cust WHERE c_acctbal > 5000
""")
def crosswalk(spark, sf_dir):
    codes = table(spark, sf_dir, "customer").select(_named("CUST", "c_custkey").alias("code"))
    return concepts.resolve_crosswalk(codes, metadata(spark, sf_dir))


@query("immediate_parents", with_sql(_ONTOLOGY) + "SELECT code, parent FROM edges")
def immediate_parents(spark, sf_dir):
    return concepts.immediate_parents(closure(spark, sf_dir))


@query("nearest_ancestor", _recursive(_ONTOLOGY, "wanted AS (SELECT DISTINCT code AS target FROM closure)", _CLIMB)
       + "SELECT target, vocab_code, hops, weights FROM climbed")
def nearest_ancestor(spark, sf_dir):
    known = cut_lineage(closure(spark, sf_dir))
    return concepts.climb(known.select(F.col("code").alias("target")), tokens(spark, sf_dir), known)


def concept_map(spark, sf_dir):
    return concepts.build_concept_map(
        concepts.code_inventory(order_events(spark, sf_dir)), tokens(spark, sf_dir), cut_lineage(closure(spark, sf_dir)),
        metadata(spark, sf_dir), concept_table(spark, sf_dir), relationship_table(spark, sf_dir),
        curated(spark, sf_dir),
    )


@query("concept_map", _recursive(_ONTOLOGY, _RESOLVED, _CLIMB, _MAP) + "SELECT * FROM concept_map")
def concept_map_query(spark, sf_dir):
    return concept_map(spark, sf_dir)


@query("coverage", _recursive(_ONTOLOGY, _RESOLVED, _CLIMB, _MAP) + """
SELECT CAST((SELECT sum(count) FROM concept_map) AS BIGINT) AS mapped_events, CAST(sum(count) AS BIGINT) AS events,
       round((SELECT sum(count) FROM concept_map) / sum(count), 9) AS coverage
FROM inventory
""")
def coverage(spark, sf_dir):
    inventory = concepts.code_inventory(order_events(spark, sf_dir))
    return concepts.coverage(concept_map(spark, sf_dir), inventory).withColumn("coverage", F.round("coverage", 9))


@query("code_rewrite", _recursive(_ONTOLOGY, _RESOLVED, _CLIMB, _MAP) + """
SELECT e.ordinal, e.subject_id, e.time, m.vocab_code AS code, e.code AS source_code
FROM order_events e JOIN concept_map m USING (code)
""")
def code_rewrite(spark, sf_dir):
    lookup = concepts.rewrite_lookup(cut_lineage(concept_map(spark, sf_dir)))
    return concepts.rewrite_codes(order_events(spark, sf_dir), lookup)


@query("code_metadata", _recursive(_ONTOLOGY, _RESOLVED, _CLIMB, _MAP) + """
SELECT v.code, coalesce(c_name, n_name, v.code) AS description, 0 AS n_parents
FROM (SELECT DISTINCT vocab_code AS code FROM concept_map UNION SELECT unnest(['MEDS_BIRTH', 'MEDS_DEATH'])) v
LEFT JOIN customer ON v.code = 'CUST/' || c_custkey LEFT JOIN nation ON v.code = 'NATION/' || n_nationkey
""")
def code_metadata(spark, sf_dir):
    lookup = concepts.rewrite_lookup(cut_lineage(concept_map(spark, sf_dir)))
    described = concepts.code_metadata(lookup, concept_table(spark, sf_dir))
    return described.select("code", "description", F.size("parent_codes").alias("n_parents"))


@query("duplicate_codes", with_sql(_ONTOLOGY, _RESOLVED) + """
SELECT code, count(*) AS count FROM resolved GROUP BY code HAVING count(*) > 1
""")
def duplicate_codes(spark, sf_dir):
    return concepts.duplicate_codes(resolver_chain(spark, sf_dir))
