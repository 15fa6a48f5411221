"""Deeply nested records as flat tables that keep their parent's keys.

Nested ``transform`` calls attach the ancestor's key and the positions (from 0, null
elements counted), ``flatten`` joins the arrays of one level, and one ``inline`` for each
target table emits the rows.  Everything stays inside the JVM and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flatten_options(contracts: DataFrame) -> DataFrame:
    """One row for each option that is not null: record_id, pos_outer, pos_inner, field, kind, option.

    Null or empty ``ambiguities``, null elements and null or empty ``options`` give no rows, but
    null elements count in the positions.  Repeated records give repeated rows.
    """
    outer = F.transform(
        F.col("ambiguities"),
        lambda a, i: F.transform(
            F.coalesce(a["options"], F.array().cast("array<string>")),
            lambda o, j: F.struct(
                i.cast("bigint").alias("pos_outer"), j.cast("bigint").alias("pos_inner"), a["field"].alias("field"), a["kind"].alias("kind"), o.alias("option")
            ),
        ),
    )
    rows = F.filter(F.flatten(outer), lambda r: r["option"].isNotNull())
    return contracts.select("record_id", F.inline(rows))


def json_lists(payload: Column, names: list[str]) -> Column:
    """The named lists of a JSON object as array<struct<list_name, elements array<variant>>>.

    A bare object counts as a list of one; an absent or null list, or text that is no JSON,
    gives an empty array.
    """
    doc = F.try_parse_json(payload)

    def one(name: str) -> Column:
        many = F.try_variant_get(doc, f"$.{name}", "array<variant>")
        single = F.try_variant_get(doc, f"$.{name}", "variant")
        bare = F.when(F.try_variant_get(doc, f"$.{name}", "map<string,variant>").isNotNull(), F.array(single))
        return F.struct(F.lit(name).alias("list_name"), F.coalesce(many, bare, F.array().cast("array<variant>")).alias("elements"))

    return F.array(*[one(n) for n in names])


def flatten_cells(cases: DataFrame) -> DataFrame:
    """One row for each claim of the lists a and b: case_id, list_name, pos_outer, claim_id, page, kind, label, cell.

    Missing objects at any depth give nulls; elements that are no objects count in the positions
    and give rows of nulls.  A case whose payload is null or no JSON gives no rows.
    """

    def text(v: Column, path: str) -> Column:
        return F.try_variant_get(v, path, "string")

    nested = F.transform(
        json_lists(F.col("payload"), ["a", "b"]),
        lambda part: F.transform(
            part["elements"],
            lambda v, i: F.struct(
                part["list_name"].alias("list_name"),
                i.cast("bigint").alias("pos_outer"),
                text(v, "$.claim_id").alias("claim_id"),
                text(v, "$.location.page").alias("page"),
                text(v, "$.location.kind").alias("kind"),
                text(v, "$.location.label").alias("label"),
                text(v, "$.location.cell").alias("cell"),
            ),
        ),
    )
    return cases.select("case_id", F.inline(F.flatten(nested)))


def flatten_uncertainty(claims: DataFrame) -> DataFrame:
    """One row for each entry of the map ``uncertainty`` that is not null: claim_uid, entry, value."""
    entries = F.transform(
        F.map_entries(F.col("uncertainty")), lambda e: F.struct(e["key"].alias("entry"), e["value"].alias("value"))
    )
    return claims.select("claim_uid", F.inline(F.filter(entries, lambda r: r["value"].isNotNull())))


def nested_keys(contracts: DataFrame, cases: DataFrame, claims: DataFrame) -> DataFrame:
    """The keys of all flat rows (child, parent_id, list_name, pos_outer, pos_inner), once each.

    Rows whose parent has no key are left out, for nothing could point to them.
    """
    minus = F.lit(-1).cast("bigint")
    options = flatten_options(contracts).select(
        F.lit("option").alias("child"), F.col("record_id").alias("parent_id"), F.lit("ambiguities").alias("list_name"), "pos_outer", "pos_inner"
    )
    cells = (
        flatten_cells(cases)
        .where(F.col("cell") != "")
        .select(F.lit("cell").alias("child"), F.col("case_id").alias("parent_id"), "list_name", "pos_outer", minus.alias("pos_inner"))
    )
    sds = (
        flatten_uncertainty(claims)
        .where(F.col("entry") == "sd")
        .select(
            F.lit("sd").alias("child"), F.col("claim_uid").cast("string").alias("parent_id"), F.lit("").alias("list_name"),
            minus.alias("pos_outer"), minus.alias("pos_inner"),
        )
    )
    return options.unionByName(cells).unionByName(sds).where(F.col("parent_id").isNotNull()).distinct()
