"""Integrity of a set of members against its manifest, and archives read in one pass."""

from __future__ import annotations

import hashlib
import tarfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MANIFEST
from ..sources import archives
from .graph import cut, shared_folder

KINDS = ("model", "image", "data", "corpus", "code")
MEMBERS = "archive string, position long, path string, bytes long, sha256 string, is_file boolean, manifest string, fault string"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a manifest's JSON."""
    whole = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", f"struct<entries:array<struct<{MANIFEST.replace(' ', ':').replace(',:', ',')}>>>")["entries"]
    return whole.select(F.inline(entries))


def members(spark: SparkSession, path: str) -> DataFrame:
    """Members of tar archives in order, each hashed as it passes; the first one's text if it is a manifest.

    An archive is read once, from its first to its last byte, a megabyte at a time. One that ends within a member
    has a last row with the fault ``truncated``.
    """

    def one(name: str) -> Iterator[tuple]:
        position, at = 0, None
        try:
            with archives.opened(name) as f, tarfile.open(fileobj=f, mode="r|*", bufsize=archives.BUFFER) as t:
                for m in t:
                    at = m.name
                    text, size, sha = b"", m.size, hashlib.sha256().hexdigest()
                    if m.isreg():
                        read, sha, text = archives.digest(t.extractfile(m), position == 0 and m.name.endswith(".json"))
                        if read < size:
                            raise tarfile.ReadError("unexpected end of data")
                    yield name, position, at, size, sha, m.isreg(), text.decode() if text else None, None
                    position, at = position + 1, None
        except (tarfile.ReadError, EOFError) as e:
            if position == 0 and at is None and "empty" in str(e):
                return  # no member at all
            yield name, position, at, None, None, None, None, "truncated"

    return archives.read_each(archives.listed(spark, path), one, MEMBERS)


def verify(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Every path of either side with its refusal, null if it is as it should be.

    ``manifest``: path, bytes, sha256; ``found``: path, bytes, sha256 and, if known, is_file. The first
    that applies: member_type, duplicate, unexpected, missing, size, digest.
    """
    plain = F.col("is_file") if "is_file" in found.columns else F.lit(True)
    there = found.groupBy("path").agg(F.count(F.lit(1)).alias("copies"), F.min("bytes").alias("found_bytes"), F.max("bytes").alias("_most"), F.min("sha256").alias("found_sha256"), F.bool_and(plain).alias("plain"))
    listed = manifest.select("path", F.col("bytes").alias("want_bytes"), F.col("sha256").alias("want_sha256"), F.lit(True).alias("listed"))
    code = (
        F.when(~F.col("plain"), "member_type").when(F.col("copies") > 1, "duplicate").when(F.col("listed").isNull(), "unexpected").when(F.col("copies").isNull(), "missing")
        .when(F.col("found_bytes") != F.col("want_bytes"), "size").when(F.col("found_sha256") != F.col("want_sha256"), "digest")
    )
    return listed.join(there, "path", "full").select("path", "want_bytes", "found_bytes", F.coalesce("copies", F.lit(0)).cast("long").alias("copies"), code.alias("refusal"))


def totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def by_kind(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("kind").agg(F.count(F.lit(1)).alias("entries"), F.sum("bytes").alias("bytes"))


def verify_archive(spark: SparkSession, path: str) -> DataFrame:
    """Refusals of one archive whose first member is its manifest. No rows: it is whole.

    One row ``manifest_not_first`` if it isn't, and one ``truncated`` with the member in which the archive ends. The
    archive is read in one pass; what is kept of it is a row for each member.
    """
    rows = members(spark, path)
    rows = cut(rows, shared_folder(rows, "archive"), "members")
    first = rows.where("position = 0 AND manifest IS NOT NULL")
    shape = "struct<entries:array<struct<path:string,bytes:bigint,sha256:string>>>"
    listed = first.select(F.inline(F.from_json("manifest", shape)["entries"]))
    broken = rows.where("fault IS NOT NULL").select("path", F.col("fault").alias("refusal"))
    checked = verify(listed, rows.where("position > 0 AND fault IS NULL")).where("refusal IS NOT NULL").select("path", "refusal")
    found = F.count_if((F.col("position") == 0) & F.col("manifest").isNotNull())
    head = rows.agg(found.alias("n"), F.min_by("path", "position").alias("path"))
    headless = head.where("n = 0").select("path", F.lit("manifest_not_first").alias("refusal"))
    # without a manifest nothing can be said of the members; what an archive lacks behind its end isn't listed twice
    judged = checked.where("refusal <> 'missing'").union(checked.where("refusal = 'missing'").join(rows.where("fault IS NOT NULL").select(F.lit(1)).limit(1), how="left_anti"))
    return headless.union(broken.union(judged).join(first.select(F.lit(1)).limit(1), how="left_semi"))


def check_files(spark: SparkSession, manifest: DataFrame, path: str) -> DataFrame:
    """Refusals of files below a folder against a manifest of names; files of any size are hashed as they are read."""
    return verify(manifest, archives.hashed(spark, path))


def select_roles(items: DataFrame, roles: list[str]) -> tuple[DataFrame, DataFrame]:
    """(wanted, skipped); an item without a role is skipped."""
    wanted = F.coalesce(F.col("role").isin(roles), F.lit(False))
    return items.where(wanted), items.where(~wanted)
