"""Running values along an order, without giving one task a whole key.

A window over (key) sends every row of a hot key to one task.  Here the order is
cut into blocks: a window runs inside each (key, block), each block is reduced to
one summary row by a partial + final aggregate, the summaries are accumulated per
key, and the accumulated value is joined back.  Both big steps are partitioned by
(key, block), so the rows are shuffled once; only summaries move again.

``block`` must not decrease along ``order`` (``session.block_of`` of an integer
order column, or a truncated time).  Rows with a null key belong together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import scratch_root

#: Block summaries that are accumulated together where there are no keys.
UPPER_BLOCK = 4096
#: The key columns as one struct: structs with nulls in them are equal, nulls are not.
_KEY = "__key"


def _inside(kind: str, value: Column, window) -> Column:
    """The running value of a kind inside one window."""
    if kind in ("last", "previous"):
        return F.last(value, ignorenulls=True).over(window)
    return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[kind](value).over(window)


def _summary(kind: str, value: Column, order: Column, descending: bool) -> Column:
    """What one block hands on to the blocks after it."""
    if kind in ("last", "previous"):
        pick = F.min_by if descending else F.max_by
        return pick(value, F.when(value.isNotNull(), order))
    return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[kind](value)


def _combine(kind: str, here: Column, before: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(here + before, here, before)
    if kind == "min":
        return F.least(here, before)
    if kind == "max":
        return F.greatest(here, before)
    if kind == "previous":
        return F.coalesce(here, before)["v"]
    return F.coalesce(here, before)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    values: Mapping[str, tuple[str, Column]],
    *,
    descending: bool = False,
    inclusive: bool = True,
    levels: int = 2,
) -> DataFrame:
    """Add running values ``{name: (kind, column)}`` of each row along ``order``.

    Kinds: sum, count, min, max, last (last non-null), previous (value of the row
    before, missing or not).  ``descending`` runs from the greatest order value
    down, ``inclusive=False`` leaves the row itself out.  Values wanted along the
    same order belong in one call: they share the shuffle.

    Without keys all block summaries belong to one order. They are accumulated in blocks
    of their own, so that what meets in one task is a row per ``UPPER_BLOCK`` blocks.
    """
    keys, order = list(keys), list(order)
    values = {
        name: (kind, F.struct(value.alias("v")) if kind == "previous" else value) for name, (kind, value) in values.items()
    }
    direction = (lambda name: F.col(name).desc()) if descending else (lambda name: F.col(name).asc())
    block_name = f"__block{levels}"
    blocked = df.withColumn(block_name, block)
    if keys:
        blocked = blocked.withColumn(_KEY, F.struct(*keys))
    key = [_KEY] if keys else []
    along = Window.partitionBy(*key, block_name).orderBy(*[direction(name) for name in order])
    with_row = along.rowsBetween(Window.unboundedPreceding, 0)
    before_row = along.rowsBetween(Window.unboundedPreceding, -1)
    across = (
        (Window.partitionBy(*key) if keys else Window.partitionBy(F.lit(0)))
        .orderBy(direction(block_name))
        .rowsBetween(Window.unboundedPreceding, -1)
    )

    def frame(kind: str):
        return with_row if inclusive and kind != "previous" else before_row

    local = blocked.select(
        "*", *[_inside(kind, value, frame(kind)).alias(f"__in_{name}") for name, (kind, value) in values.items()]
    )
    position = F.struct(*order)
    summaries = blocked.groupBy(*key, block_name).agg(
        *[_summary(kind, value, position, descending).alias(f"__sum_{name}") for name, (kind, value) in values.items()]
    )
    handed_on = {"count": "sum", "previous": "last"}
    if keys or levels == 1:
        carried = summaries.select(
            *key,
            block_name,
            *[
                _inside(handed_on.get(kind, kind), F.col(f"__sum_{name}"), across).alias(f"__carry_{name}")
                for name, (kind, _) in values.items()
            ],
        )
    else:
        before = {f"__carry_{name}": (handed_on.get(kind, kind), F.col(f"__sum_{name}")) for name, (kind, _) in values.items()}
        upper = F.floor(F.col(block_name) / UPPER_BLOCK).cast("long")
        carried = running(summaries, [], [block_name], upper, before, descending=descending, inclusive=False, levels=1)
        carried = carried.select(block_name, *before)
    joined = local.join(carried, [*key, block_name], "left")
    return joined.select(
        *df.columns,
        *[
            _combine(kind, F.col(f"__in_{name}"), F.col(f"__carry_{name}")).alias(name)
            for name, (kind, _) in values.items()
        ],
    )


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    values: Mapping[str, Column],
    *,
    following: bool = False,
) -> DataFrame:
    """Value of the row just before (or ``following``) along ``order``: lag and lead."""
    return running(
        df, keys, order, block, {name: ("previous", value) for name, value in values.items()}, descending=following
    )


def settled(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared checkpoint folder.

    A running value reads its input twice, so one on top of another would compute
    the lower one twice; this is put between the two.
    """
    scratch_root(df.sparkSession)
    return df.checkpoint()


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    name: str,
    *,
    descending: bool = False,
) -> DataFrame:
    """Row number from 1 along ``order`` (which must be unique within the key)."""
    return running(df, keys, order, block, {name: ("count", F.lit(1))}, descending=descending)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key.

    ``row_number() <= n`` over a key becomes a partial group limit before the
    shuffle, so a map task sends at most ``n`` rows of a hot key.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(window)).filter(F.col("__rn") <= n).drop("__rn")
