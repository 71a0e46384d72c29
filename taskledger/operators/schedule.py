"""How a poll's claim is split over names under joint ceilings: of the worker, of names, and of resources that names share."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import is_due, one_of
from ..schema import RUNNING


class Draw(NamedTuple):
    """Names that draw together: those that share a draw get a task a call. A call takes `batch` tasks at most; concurrency and the resource's capacity count calls."""

    names: tuple[str, ...]
    batch: int = 1
    concurrency: int | None = None
    resource: str | None = None


def draws_of(handlers: dict[str, dict]) -> list[Draw]:
    """The draws of handlers (batch, concurrency, resource by name): a name that limits itself draws alone, in order, the others together, last."""
    alone = [Draw((name,), h.get("batch") or 1, h.get("concurrency"), h.get("resource")) for name, h in handlers.items() if any(h.get(k) is not None for k in ("batch", "concurrency", "resource"))]
    shared = tuple(name for name in handlers if name not in {d.names[0] for d in alone})
    return alone + ([Draw(shared)] if shared else [])


def claim_by_ceilings(
    tasks: DataFrame, draws: Sequence[Draw], worker: str, now: int, free: int, resources: dict[str, int], start: int = 0, claim_batch: int | None = None, queues: Sequence[str] | None = None
) -> DataFrame:
    """(id, name, draw, call): what a worker with `free` calls to spare claims, draw by draw from that at `start` on, and in which call of its draw it goes.

    A draw's calls are bounded by what is left of the worker's, by `claim_batch` rows (one call at least), by its names' concurrency less the calls of
    theirs that the worker runs, and by its resource's capacity less those that run and those that draws before have taken. A draw with few tasks due takes that much less from the others. Calls that run
    follow from the worker's running rows and the batch. The recurrence over draws is one row's; the rest are counts by name, and a top-k that each partition cuts before rows meet.
    """
    draws = list(draws)
    turns = [(start + i) % len(draws) for i in range(len(draws))] if draws else []
    names = [name for d in draws for name in d.names]
    due = tasks.where(is_due(now) & one_of("queue", queues) & one_of("name", names)).withColumn("draw", _number(draws))
    held = sorted({d.resource for d in draws if d.resource is not None})
    flying = tasks.where((F.col("status") == RUNNING) & (F.col("worker_id") == worker) & one_of("name", names))

    def counted(rows: DataFrame, prefix: str) -> DataFrame:
        return rows.agg(*[F.coalesce(F.count_if(F.col("name").isin(*d.names)), F.lit(0)).alias(f"{prefix}{i}") for i, d in enumerate(draws)])

    if not draws:
        return due.select("id", "name", "draw", F.lit(0).cast("long").alias("call")).limit(0)
    one = counted(due, "due").crossJoin(F.broadcast(counted(flying, "run")))  # a row each

    def calls(prefix: str, i: int) -> Column:
        return F.ceil(F.col(f"{prefix}{i}") / draws[i].batch)

    def ceiling(i: int) -> Column:
        own = [F.lit(max(1, claim_batch // draws[i].batch)).cast("long")] if claim_batch is not None else []
        own += [F.greatest(F.lit(0).cast("long"), F.lit(draws[i].concurrency) - calls("run", i))] if draws[i].concurrency is not None else []
        return F.least(F.lit(free).cast("long"), F.lit(free).cast("long"), *own)

    capacity = [F.greatest(F.lit(0).cast("long"), F.lit(resources[r]) - sum((calls("run", i) for i, d in enumerate(draws) if d.resource == r), F.lit(0))) for r in held]
    def resource(i: int) -> Column:
        return F.lit(None if draws[i].resource is None else held.index(draws[i].resource)).cast("int")

    steps = F.array(*[F.struct(F.lit(i).alias("draw"), ceiling(i).alias("most"), calls("due", i).alias("due"), resource(i).alias("of")) for i in turns])
    nothing = F.array().cast("array<struct<draw:int,calls:bigint>>")
    begin = F.struct(F.lit(free).cast("long").alias("left"), F.array(*capacity).cast("array<bigint>").alias("room"), nothing.alias("given"))

    def step(state: Column, x: Column) -> Column:
        given = F.greatest(F.lit(0).cast("long"), F.least(state["left"], x["most"], x["due"], F.when(x["of"].isNotNull(), F.get(state["room"], x["of"]))))
        room = F.transform(state["room"], lambda n, i: n - F.when(i == x["of"], given).otherwise(0))
        return F.struct((state["left"] - given).alias("left"), room.alias("room"), F.concat(state["given"], F.array(F.struct(x["draw"].alias("draw"), given.alias("calls")))).alias("given"))

    given = one.select(F.explode(F.aggregate(steps, begin, step)["given"]).alias("g")).select("g.draw", "g.calls")  # a row a draw
    order = Window.partitionBy("draw").orderBy(F.col("priority").desc(), "run_at_ms", "id")
    most = free * max(d.batch for d in draws)
    ranked = due.withColumn("_place", F.row_number().over(order) - 1).where(F.col("_place") < most)
    batch = F.element_at(F.array(*[F.lit(d.batch) for d in draws]), F.col("draw") + 1)
    rows = ranked.withColumn("call", F.floor(F.col("_place") / batch)).join(F.broadcast(given), "draw")
    return rows.where(F.col("call") < F.col("calls")).select("id", "name", "draw", "call")


def _number(draws: Sequence[Draw]) -> Column:
    number = F.lit(None).cast("int")
    for i, d in enumerate(draws):
        number = F.when(F.col("name").isin(*d.names), i).otherwise(number)
    return number
