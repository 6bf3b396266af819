"""Reports: rate guard, factual findings, caveats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as rules

#: Whether the detector's precision has been measured; until then no rate may be quoted.
PRECISION_VALIDATED = False
MOST_LEADS = 10
LEAD_CAVEAT = "An unmatched detection is a lead for further collection, not a conclusion."


def scrub(claims: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(claims that may be published, claims that state a rate). A null text states none."""
    rate = F.coalesce(rules.states_a_rate(F.col(text_col)), F.lit(False))
    return claims.where(~rate), claims.where(rate)


def rate_verdict(matches: DataFrame, source_col: str = "source") -> DataFrame:
    """One row: quotable and the reasons why not."""
    found = matches.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_and("source_is_ground_truth"), F.lit(False)).alias("gt"), F.array_join(F.array_sort(F.collect_set(F.coalesce(F.col(source_col), F.lit("unknown")))), ", ").alias("sources"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("n") == 0, "There are no matches to take a rate from."),
            F.when((F.col("n") > 0) & ~F.col("gt"), F.concat(F.lit("The feed isn't ground truth: "), F.col("sources"), F.lit("."))),
            F.lit(None if PRECISION_VALIDATED else "The detector's precision hasn't been validated."),
        )
    )
    return found.select((F.size(reasons) == 0).alias("quotable"), reasons.alias("reasons"))


def findings(matches: DataFrame, *by: str) -> DataFrame:
    """Counted statements per group; none is a proportion."""
    n, dark = F.count(F.lit(1)), F.count_if(F.col("status") == "dark")
    grouped = matches.groupBy(*by) if by else matches.groupBy()
    return grouped.agg(
        F.format_string("%d of %d detections had no AIS correspondence.", dark, n).alias("unmatched"),
        F.format_string("%d detections corresponded to %d vessels.", n - dark, F.countDistinct("mmsi")).alias("matched"),
    )


def leads(matches: DataFrame, most: int = MOST_LEADS) -> DataFrame:
    """The longest unmatched detections, a few for a report."""
    return matches.where("status = 'dark'").orderBy(F.desc_nulls_last("length_m"), "detection_id").limit(most)


def cited_marking(claims: DataFrame, chunks: DataFrame, *by: str) -> DataFrame:
    """(by..., classification): the marking of what the claims (``by``, chunk_ids) cite of ``chunks`` (chunk_id, classification), each chunk once."""
    cited = claims.select(*by, F.explode("chunk_ids").alias("chunk_id")).distinct()
    return cited.join(chunks.select("chunk_id", "classification"), "chunk_id").groupBy(*by).agg(rules.combined_marking(F.col("classification")).alias("classification"))


def report(matches: DataFrame, chunks: DataFrame, claims: DataFrame, area: str, date: str) -> DataFrame:
    """One row: title, findings, published and removed claims, leads, caveats, marking. Never releasable by itself."""
    kept, removed = scrub(claims)
    as_list = lambda df, c, name, order: df.agg(F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda x: x[c]).alias(name))
    kept_rows = kept.select("claim_no", "text").orderBy("claim_no")
    parts = [
        findings(matches),
        as_list(kept_rows, "text", "claims", "claim_no"),
        removed.agg(F.count(F.lit(1)).alias("removed_claims")),
        leads(matches).agg(F.array_sort(F.collect_list("detection_id")).alias("leads")),
        rate_verdict(matches, "source" if "source" in matches.columns else "status"),
        cited_marking(kept, chunks),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out.withColumns({"title": F.lit(f"INTREP — {area} — {date}"), "caveat": F.lit(LEAD_CAVEAT), "releasable": F.lit(False)})
