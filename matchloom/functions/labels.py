"""Label sets of metrics as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_string(labels: Column) -> Column:
    """`{a="1",b="2"}` with sorted keys; empty without labels."""
    entries = F.array_sort(F.map_entries(F.coalesce(labels, F.create_map().cast("map<string,string>"))))
    quoted = F.transform(entries, lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    return F.when(F.size(quoted) == 0, F.lit("")).otherwise(
        F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))
    )


def with_label(label_text: Column, key: str, value: Column) -> Column:
    """Append one label to a label string."""
    pair = F.concat(F.lit(f'{key}="'), value, F.lit('"}'))
    return F.when(label_text == "", F.concat(F.lit("{"), pair)).otherwise(
        F.concat(F.regexp_replace(label_text, r"\}$", ","), pair)
    )


def counter_name(name: Column) -> Column:
    """Counters end in `_total`, once."""
    return F.when(name.endswith("_total"), name).otherwise(F.concat(name, F.lit("_total")))


def edge_text(edge: Column) -> Column:
    """An edge without needless decimals; NULL is the overflow bucket."""
    plain = F.regexp_replace(F.format_string("%.3f", edge), r"\.?0+$", "")
    return F.when(edge.isNull(), F.lit("+Inf")).otherwise(plain)


def by_score(details: Column) -> Column:
    """Expert details, best score first, ties by name."""

    def compare(a: Column, b: Column) -> Column:
        return (
            F.when(a["score"] > b["score"], -1)
            .when(a["score"] < b["score"], 1)
            .when(a["agent"] < b["agent"], -1)
            .when(a["agent"] > b["agent"], 1)
            .otherwise(0)
        )

    return F.array_sort(details, compare)
