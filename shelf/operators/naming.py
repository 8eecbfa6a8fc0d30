"""Collision-free names: the serial rule, cut into independent pieces that run in parallel.

Destinations collide by their case-folded form within a run and by their exact path on
disk. All names that suffixing can reach from a path lie in its *family* (folder, stem
without trailing ``_n``, extension), so families are independent once duplicates are
known. Where existing files are skipped, whether a twin counts depends on naming; then the
rule runs over connected components of families and digest classes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelf.functions.names import family_of, fold, fold_of
from shelf.storage import keep

DECIDED = "pos long, dest_rel string, action string, reason string, duplicate_of string"


def _suffixed(path: str, n: int) -> str:
    head, slash, name = path.rpartition("/")
    cut = name.rfind(".")
    front, ext = (name[:cut], name[cut:]) if cut > 0 else (name, "")
    return f"{head}{slash}{front}_{n}{ext}"


def decide(rows: pd.DataFrame, existing: set[str], mode: str, on_conflict: str, dedup: bool) -> list[tuple]:
    """The serial rule over rows in position order; yields ``DECIDED`` tuples.

    Rows have ``pos, source_rel, size, digest, wanted, journal_dest, dest_match``.
    """
    taken: set[str] = set()
    next_free: dict[str, int] = {}
    twins: dict[tuple, tuple[str, str]] = {}
    out = []
    for r in rows.sort_values("pos").itertuples(index=False):
        key = (r.size, r.digest) if dedup and isinstance(r.digest, str) else None
        if isinstance(r.journal_dest, str):
            taken.add(fold(r.journal_dest))
            if key:
                twins.setdefault(key, (r.source_rel, r.journal_dest))
            out.append((r.pos, r.journal_dest, "skip", "already-done", None))
            continue
        if key and key in twins:
            source, dest = twins[key]
            out.append((r.pos, dest, "skip", "duplicate-of-source", source))
            continue
        if key and isinstance(r.dest_match, str):
            out.append((r.pos, r.dest_match, "skip", "duplicate-of-destination", r.dest_match))
            continue
        dest, action, reason = r.wanted, mode, "planned"
        in_run, on_disk = fold(dest) in taken, dest in existing
        if not in_run and on_disk and on_conflict == "skip":
            action, reason = "skip", "existing-file"
        elif not in_run and on_disk and on_conflict == "overwrite":
            action, reason = "overwrite", "existing-file"
        elif in_run or on_disk:
            # names are never given back, so the search resumes where it last ended
            n = next_free.get(r.wanted, 1)
            while fold(dest := _suffixed(r.wanted, n)) in taken or dest in existing:
                n += 1
            next_free[r.wanted], reason = n + 1, "renamed"
        taken.add(fold(dest))
        if key and action != "skip":
            twins[key] = (r.source_rel, dest)
        out.append((r.pos, dest, action, reason, None))
    return out


def _by_fold(rows: DataFrame, existing: DataFrame, key: str, mode: str, on_conflict: str, dedup: bool) -> DataFrame:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = decide(left, set(right["path"]), mode, on_conflict, dedup)
        return pd.DataFrame(found, columns=["pos", "dest_rel", "action", "reason", "duplicate_of"])

    columns = [key, "pos", "source_rel", "size", "digest", "wanted", "journal_dest", "dest_match"]
    return rows.select(*columns).groupBy(key).cogroup(existing.select(key, "path").groupBy(key)).applyInPandas(run, DECIDED)


def assign(rows: DataFrame, existing: DataFrame, mode: str, on_conflict: str) -> DataFrame:
    """``DECIDED`` rows where duplicates are settled already (rename and overwrite).

    Families without names on disk and of one folded name, nearly all, are numbered by a
    window in the JVM; a folder full of one name is a sort there. Families that the journal
    holds whole need no rule. Only the others run the serial rule in Python.
    """
    named = rows.withColumn("family", family_of(F.coalesce("journal_dest", "wanted")))
    held = existing.select("path", family_of(F.col("path")).alias("family"))
    on_disk = held.select("family").distinct().withColumn("held", F.lit(True))
    # one row for each family is joined back, so a large family costs one row here
    folded = fold_of(F.col("wanted"))
    plain = named.groupBy("family").agg(
        F.min(F.col("journal_dest").isNotNull()).alias("done"),
        (F.max(F.col("journal_dest").isNotNull()) | (F.min(folded) != F.max(folded))).alias("mixed"),
    )
    hard = F.when(F.col("done"), F.lit(False)).otherwise(F.col("mixed") | F.coalesce("held", F.lit(False)))
    split = named.join(plain.join(on_disk, "family", "left").select("family", "done", hard.alias("hard")), "family")
    order = Window.partitionBy("family").orderBy("pos")
    done = split.where("done").select(
        "pos", F.col("journal_dest").alias("dest_rel"), F.lit("skip").alias("action"), F.lit("already-done").alias("reason"), F.lit(None).cast("string").alias("duplicate_of")
    )
    easy = split.where("not hard and not done").withColumn("n", F.row_number().over(order) - 1)
    front, ext = F.regexp_extract("wanted", r"(?s)^(.*[^/])\.[^./]*$", 1), F.regexp_extract("wanted", r"(?s)[^/](\.[^./]*)$", 1)
    numbered = F.concat(F.when(ext == "", F.col("wanted")).otherwise(front), F.lit("_"), F.col("n"), ext)
    easy = easy.select(
        "pos",
        F.when(F.col("n") == 0, F.col("wanted")).otherwise(numbered).alias("dest_rel"),
        F.lit(mode).alias("action"),
        F.when(F.col("n") == 0, F.lit("planned")).otherwise(F.lit("renamed")).alias("reason"),
        F.lit(None).cast("string").alias("duplicate_of"),
    )
    hard = split.where("hard")
    return easy.unionByName(done).unionByName(_by_fold(hard, held, "family", mode, on_conflict, dedup=False))


def assign_by_component(rows: DataFrame, existing: DataFrame, mode: str, on_conflict: str, dedup: bool) -> DataFrame:
    """``DECIDED`` rows by the whole rule over components of families and digest classes."""
    named = rows.withColumn("family", family_of(F.coalesce("journal_dest", "wanted")))
    names = keep(named.select("pos", "family", "size", "digest", F.col("pos").alias("part")))
    while True:
        least = names.groupBy("family").agg(F.min("part").alias("a"))
        after = names.join(least, "family").select("pos", "family", "size", "digest", F.col("part").alias("before"), F.col("a").alias("part"))
        if dedup:
            joint = after.where("digest is not null").groupBy("size", "digest").agg(F.min("part").alias("b"))
            after = after.join(joint, ["size", "digest"], "left").select("pos", "family", "size", "digest", "before", F.least("part", F.coalesce("b", "part")).alias("part"))
        after = keep(after)
        changed = after.where("part <> before").limit(1).count()
        names = after.drop("before")
        if not changed:
            break
    parts = names.groupBy("family").agg(F.min("part").alias("part"))
    held = existing.select("path", family_of(F.col("path")).alias("family")).join(parts, "family").select("path", "part")
    return _by_fold(named.join(names.select("pos", "part"), "pos"), held, "part", mode, on_conflict, dedup)
