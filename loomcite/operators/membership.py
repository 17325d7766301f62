"""Projects: membership, tabs, counts and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.text import venue_rank
from .folds import upsert_rows
from .ranking import first_per_key, page

# own choice: a venue class weighs more than any score or year difference within it
COMPOSITE = {"venue": 10.0, "relevance": 1.0, "year": 0.001}


def upsert_memberships(current: DataFrame, incoming: DataFrame) -> DataFrame:
    keyed = incoming.withColumn("membership_id", stable_id("PM", "project_id", "record_type", "record_id"))
    return upsert_rows(current, keyed, ["project_id", "record_type", "record_id"])


def visible(memberships: DataFrame) -> DataFrame:
    return memberships.filter(~F.coalesce("hidden", F.lit(False)))


def counts_by_type(memberships: DataFrame) -> DataFrame:
    return visible(memberships).groupBy("project_id", "record_type").agg(F.count(F.lit(1)).alias("n"))


def project_concepts(concepts: DataFrame, memberships: DataFrame, project_id: str) -> DataFrame:
    """Concepts with a visible membership under ``concept`` or under their own type."""
    mine = visible(memberships).filter(F.col("project_id") == project_id).select("record_type", "record_id")
    keyed = concepts.withColumn("_type", F.explode(F.array(F.lit("concept"), F.col("concept_type"))))
    hit = (F.col("_type") == mine["record_type"]) & (F.col("concept_id") == mine["record_id"])
    ids = keyed.join(mine, hit, "left_semi").select("concept_id").distinct()
    return concepts.join(ids, "concept_id", "left_semi")


def project_detail(works: DataFrame, memberships: DataFrame, project_id: str, *facts: DataFrame) -> list[DataFrame]:
    """A project's works and, newest first, the facts about them."""
    mine = visible(memberships).filter((F.col("project_id") == project_id) & (F.col("record_type") == "work"))
    kept = works.join(mine.select(F.col("record_id").alias("work_id")), "work_id", "left_semi")
    ids = kept.select("work_id")
    return [kept, *[f.join(ids, "work_id", "left_semi").orderBy(F.desc("seq")) for f in facts]]


def tab_page(memberships: DataFrame, offset: int, limit: int, keys: tuple[str, ...] = ("project_id", "record_type")) -> DataFrame:
    order = [F.asc(F.coalesce("display_order", F.lit(0))), F.asc("created_at"), F.asc("record_id")]
    return page(visible(memberships), keys, order, offset, limit)


def sort_key(mode: str) -> list[Column]:
    """Sort columns of a tab; rows carry modified, relevance, work_year, venue, record_id."""
    if mode == "modified":
        main = [F.desc("modified")]
    elif mode == "relevance":
        main = [F.desc(F.round("relevance", 9))]
    elif mode == "work_year":
        main = [F.desc(F.coalesce("work_year", F.lit(0)))]
    elif mode == "composite":
        blend = (
            COMPOSITE["venue"] * venue_rank("venue")
            + COMPOSITE["relevance"] * F.col("relevance")
            + COMPOSITE["year"] * F.coalesce("work_year", F.lit(0))
        )
        main = [F.desc(F.round(blend, 9))]
    else:
        raise ValueError(f"unknown sort mode: {mode}")
    return [*main, F.asc("record_id")]


def work_years(links: DataFrame, works: DataFrame) -> DataFrame:
    """Latest year of the works a record is linked to."""
    return links.join(works.select("work_id", "year"), "work_id").groupBy("record_id").agg(F.max("year").alias("work_year"))


def project_list(projects: DataFrame, memberships: DataFrame, runs: DataFrame, types: list[str]) -> DataFrame:
    """Projects but ``default``, with a count per record type and the last run's status."""
    counts = visible(memberships).groupBy("project_id").agg(
        *[F.count_if(F.col("record_type") == t).alias(f"n_{t}") for t in types]
    )
    last = first_per_key(runs, ["project_id"], [F.desc("updated_at"), F.desc("run_id")]).select(
        "project_id", F.col("status").alias("last_status")
    )
    shown = projects.filter("project_id <> 'default'")
    return shown.join(counts, "project_id", "left").join(last, "project_id", "left").fillna(0, [f"n_{t}" for t in types])


def reorder(projects: DataFrame, wanted: DataFrame) -> DataFrame:
    """Projects named in ``wanted`` (pos, project_id) get that place; others keep theirs."""
    new = wanted.select("project_id", F.col("pos").alias("_pos"))
    return projects.join(new, "project_id", "left").withColumn("display_order", F.coalesce("_pos", "display_order")).drop("_pos")


def delete_shallow(memberships: DataFrame, deleted: DataFrame) -> DataFrame:
    """Drop the memberships of deleted projects and nothing else."""
    return memberships.join(deleted.select("project_id"), "project_id", "left_anti")


def delete_deep(tables: dict[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """Rows each table loses when projects go with their data.

    Order matters: memberships; concepts no other project holds, with their symbols,
    evidence and versions; derivations; then works no other project holds and no
    remaining evidence cites. Returns the deleted rows per table, from which counts
    and, by anti join, the remaining tables follow; ``derivation_node_unlinked`` are
    nodes whose concept goes away.
    """
    gone = deleted.select("project_id").distinct()
    membership = tables["membership"]
    mine = membership.join(gone, "project_id", "left_semi")
    kept = membership.join(gone, "project_id", "left_anti")
    is_work = F.col("record_type") == "work"
    ids = lambda df, name: df.select(F.col("record_id").alias(name)).distinct()

    orphan = ids(mine.filter(~is_work), "concept_id").join(ids(kept.filter(~is_work), "concept_id"), "concept_id", "left_anti")
    out = {"membership": mine, "concept": tables["concept"].join(orphan, "concept_id", "left_semi")}
    lost = out["concept"].select("concept_id")
    for name in ("symbol", "evidence", "concept_version"):
        if name in tables:
            out[name] = tables[name].join(lost, "concept_id", "left_semi")
    if "derivation_run" in tables:
        out["derivation_run"] = tables["derivation_run"].join(gone, "project_id", "left_semi")
        runs = out["derivation_run"].select("derivation_id")
        for name in ("derivation_edge", "derivation_node"):
            out[name] = tables[name].join(runs, "derivation_id", "left_semi")
        left = tables["derivation_node"].join(runs, "derivation_id", "left_anti")
        out["derivation_node_unlinked"] = left.join(lost, "concept_id", "left_semi")
    cited = tables["evidence"].join(lost, "concept_id", "left_anti").select("work_id").filter("work_id is not null")
    free = ids(mine.filter(is_work), "work_id").join(ids(kept.filter(is_work), "work_id"), "work_id", "left_anti")
    out["work"] = tables["work"].join(free, "work_id", "left_semi").join(cited, "work_id", "left_anti")
    for name in ("work_version", "extraction_run"):
        if name in tables:
            out[name] = tables[name].join(out["work"].select("work_id"), "work_id", "left_semi")
    return out


def deleted_counts(deleted: dict[str, DataFrame]) -> DataFrame:
    counts = None
    for name, rows in deleted.items():
        one = rows.agg(F.count(F.lit(1)).alias("n_deleted")).select(F.lit(name).alias("table_name"), "n_deleted")
        counts = one if counts is None else counts.unionByName(one)
    return counts
