"""Host samples per search region: validation, labels, caps and region geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import geo
from tidewatch.functions import vocabulary as V
from tidewatch.operators.numbering import top_per

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"
_H16 = r"[0-9A-Fa-f]{1,4}"
IPV6 = (
    rf"^(?:(?:{_H16}:){{7}}{_H16}|(?:{_H16}:){{1,7}}:|:(?::{_H16}){{1,7}}|::"
    + "".join(rf"|(?:{_H16}:){{1,{7 - n}}}(?::{_H16}){{1,{n}}}" for n in range(1, 7))
    + r")(?:%[^\s%]+)?$"
)


def valid_hosts(hosts: DataFrame) -> DataFrame:
    """Rows with a real address and provider coordinates; ports sorted, distinct, 0..65535.

    ``hosts``: ``ip, latitude, longitude, country_code, ports`` (array of int) and anything else.
    """
    c = F.col
    located = (
        c("latitude").between(-90, 90) & c("longitude").between(-180, 180)
        & ~F.isnan("latitude") & ~F.isnan("longitude")
    )
    ports = F.array_sort(F.array_distinct(
        F.filter(F.coalesce("ports", F.array().cast("array<int>")), lambda p: p.between(0, 65535))
    ))
    usable = located & (c("ip").rlike(IPV4) | c("ip").rlike(IPV6))
    return hosts.filter(F.coalesce(usable, F.lit(False))).withColumns(
        {"country_code": F.upper(F.substring(F.coalesce("country_code", F.lit("")), 1, 2)), "ports": ports}
    )


def region_label() -> Column:
    """Short label of a region row (``kind, name, south, west``)."""
    c = F.col
    name = F.nullif(F.substring(F.trim("name"), 1, 40), F.lit(""))
    box = F.coalesce(F.format_string("box %.2f/%.2f", c("south"), c("west")), F.lit("region"))
    box = F.when(c("south").isNull() | c("west").isNull(), "region").otherwise(box)
    return (
        F.when(c("kind") == "country", name)
        .when(c("kind") == "bbox", box)
        .otherwise(F.nullif(F.substring("kind", 1, 16), F.lit("")))
    )


def region_circle() -> Column:
    """Search circle of a box region; null unless the box is valid."""
    c = F.col
    ok = (
        (c("kind") == "bbox") & c("west").between(-180, 180) & c("east").between(-180, 180)
        & c("south").between(-90, 90) & c("north").between(-90, 90) & (c("south") <= c("north"))
    )
    return F.when(ok, geo.box_circle(c("west"), c("south"), c("east"), c("north")))


def host_sample(
    hosts: DataFrame, per_region: int = V.HOSTS_PER_REGION, regions: int = V.HOST_REGIONS, total: int = V.HOSTS_TOTAL
) -> DataFrame:
    """The published sample: first rows of the first regions, in order (``region_pos, host_pos``).

    The caps are the sample's definition, and both are applied as top-k.
    """
    shown = hosts.filter(F.col("region_pos") < regions)
    capped = top_per(shown, ["region_pos"], per_region, F.col("host_pos").asc())
    return capped.drop("rank").orderBy("region_pos", "host_pos").limit(total)
