"""The ontology: entities with aliases, directed relationships, and what may not enter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTITIES = "id string, name string, kind string, aliases array<string>"


def dangling(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """(subject, predicate, object, missing): relationships an end of which is no declared entity."""
    ids = entities.select("id").distinct()
    ends = [relationships.join(ids, F.col(end) == F.col("id"), "left_anti").withColumn("missing", F.col(end)) for end in ("subject", "object")]
    return ends[0].unionByName(ends[1]).select("subject", "predicate", "object", "missing").distinct()


def load(entities: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, triples) fit to be stored: the last row of an id and the least id of a name count,
    relationships once each. A relationship with an undeclared end is an error, which names it."""
    bad = dangling(entities, relationships).orderBy("subject", "predicate", "object").first()
    if bad:
        raise ValueError(f"relationship {bad['subject']!r} -{bad['predicate']}-> {bad['object']!r} names the undeclared entity {bad['missing']!r}")
    one = entities.groupBy("id").agg(F.max(F.struct(F.coalesce("name", "id").alias("name"), F.coalesce("kind", F.lit("concept")).alias("kind"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))).alias("e"))
    named = one.select("id", "e.*").groupBy("name").agg(F.min(F.struct("id", "kind", "aliases")).alias("e")).select("e.id", "name", "e.kind", "e.aliases")
    return named, relationships.distinct()


def surfaces(entities: DataFrame) -> DataFrame:
    """(entity, surface): each entity under its name and its aliases, for ``retrieval.match_entities``."""
    names = F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return entities.select(F.col("id").alias("entity"), F.explode(names).alias("surface")).where("surface is not null").distinct()


def edges(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """(subject, subject_kind, predicate, object, object_kind): the triples with the names of both ends."""
    side = lambda n: entities.select(F.col("id").alias(f"{n}_id"), F.col("name").alias(n), F.col("kind").alias(f"{n}_kind"))
    rows = triples.select(F.col("subject").alias("subject_id"), "predicate", F.col("object").alias("object_id"))
    return rows.join(side("subject"), "subject_id").join(side("object"), "object_id").select("subject", "subject_kind", "predicate", "object", "object_kind")


def expand_edges(start: DataFrame, triples: DataFrame, hops: int = 2) -> DataFrame:
    """(text_id, entity, hop, predicate, direction): entities within ``hops`` steps either way of the start,
    at their least distance, with the least edge that leads there: ``out`` along it, ``in`` against it."""
    way = lambda a, b, d: triples.select(F.col(a).alias("a"), F.col(b).alias("b"), "predicate", F.lit(d).alias("direction"))
    both = way("subject", "object", "out").unionByName(way("object", "subject", "in")).distinct()
    seen = start.select("text_id", "entity").distinct()
    frontier, out = seen, None
    for hop in range(1, hops + 1):
        met = frontier.join(both, F.col("entity") == F.col("a")).groupBy("text_id", F.col("b").alias("entity")).agg(F.min(F.struct("predicate", "direction")).alias("e"))
        new = met.join(seen, ["text_id", "entity"], "left_anti").select("text_id", "entity", F.lit(hop).alias("hop"), "e.predicate", "e.direction")
        out = new if out is None else out.unionByName(new)
        frontier = new.select("text_id", "entity")
        seen = seen.unionByName(frontier)
    return out
