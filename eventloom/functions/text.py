"""Names, phrases, JSON fields and fingerprints as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions import counter


def json_field(doc: str | Column, path: str, default=None) -> Column:
    """A JSON field as text, with a default for missing or null."""
    got = F.get_json_object(doc, path)
    return got if default is None else F.coalesce(got, F.lit(default))


def json_safe(c: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def json_safe_array(c: Column) -> Column:
    return F.transform(c, json_safe)


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON text with sorted keys; NULL fields are kept as null."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(F.to_json(F.array(fields[k])).substr(F.lit(2), F.length(F.to_json(F.array(fields[k]))) - 2), F.lit("null"))) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def fingerprint(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def big_number(n: Column, digits: int = 0) -> Column:
    """1234 -> 1K, 5.6e6 -> 6M and so on; values of a thousand quadrillions or more stay plain."""
    e = None
    for i, suffix in enumerate(("", "K", "M", "B", "T", "Q")):
        scaled = n / F.lit(1000.0**i)
        text = F.concat(F.format_string(f"%.{digits}f", F.bround(scaled, digits)), F.lit(suffix))
        e = F.when(F.abs(scaled) < 1000, text) if e is None else e.when(F.abs(scaled) < 1000, text)
    return e.otherwise((n / F.lit(1e18)).cast("string"))


def demo_number(path: Column) -> Column:
    return F.try_to_number(F.regexp_extract(path, r"demo(\d+)", 1), F.lit("9999999999")).cast("long")


def checkpoint_name(path: Column) -> dict[str, Column]:
    """Parent folder and epoch of a file path; the epoch is NULL when absent."""
    parts = F.split(path, "/")
    epoch = F.regexp_extract(F.element_at(parts, -1), r"epoch(\d+)", 1)
    return {"experiment": F.element_at(parts, -2), "epoch": F.when(epoch != "", epoch.cast("int"))}


def strip_suffix(name: Column) -> Column:
    """Drops a trailing four-hex-digit suffix."""
    return F.regexp_replace(name, r"_[0-9a-f]{4}$", "")


def episode_name(task, robot, kind, moving: Column, n: Column, seed: Column, suffix: Column) -> Column:
    d = F.when(moving, "d").otherwise("s")
    return F.format_string("%s_%s_%s%s_O%02d_%08d_%s", task, robot, kind, d, n, seed, suffix)


def instruction(task: Column, obj: Column, container: Column) -> Column:
    obj, container = F.coalesce(obj, F.lit("object")), F.coalesce(container, F.lit("container"))
    return F.when(task == "place", F.format_string("Place the %s in the %s.", obj, container)).otherwise(F.format_string("Pick up the %s.", obj))


# fixed values: verbs of the random instruction form
PICK_VERBS = ["pick up", "grasp", "catch", "grab", "get hold of"]
PLACE_VERBS = ["place on", "put on", "set on", "position on", "return to", "deposit in"]


def random_instruction(task: Column, obj: Column, container: Column, seed: int, *ids: Column) -> Column:
    """One of the verb forms per row, chosen by a counter so that reruns agree."""
    pick = F.get(F.array(*[F.lit(v) for v in PICK_VERBS]), counter.pick(seed, "pick", len(PICK_VERBS), *ids))
    place = F.get(F.array(*[F.lit(v) for v in PLACE_VERBS]), counter.pick(seed, "place", len(PLACE_VERBS), *ids))
    return (F.when(task == "pick", F.format_string("%s the %s.", pick, obj))
            .when(task.isin("place", "long-horizon"), F.format_string("%s the %s and %s the %s.", pick, obj, place, container)))


def longest_match(text: Column, names: list[str]) -> Column:
    """The longest of a given list of names that occurs in a text (first in name order on ties)."""
    ordered = sorted(names, key=lambda n: (-len(n), n))
    e = F.lit(None).cast("string")
    for n in reversed(ordered):
        e = F.when(F.contains(text, F.lit(n.lower())), F.lit(n)).otherwise(e)
    return e
