"""Controls of a run: which stages, what is left when one fails, where a source goes on, how much work a run takes on.

Sources are given as functions, so nothing here touches a network; state is a small table of cursors, a row a source.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CURSOR = "source string, next int, last int, done boolean"


def selected(stages: Sequence[str], *, only: Iterable[str] | None = None, groups: Mapping[str, Sequence[str]] | None = None, optional: Sequence[str] = (), costly: Sequence[str] = (), dry_run: bool = False) -> list[str]:
    """The stages of a run in their order: all, without the ``costly`` ones in a dry run; or those asked for, groups spelt out, ``optional``
    ones only if asked for. An unknown name raises."""
    if only is None:
        return [s for s in stages if not (dry_run and s in costly)]
    wanted: set[str] = set()
    for name in only:
        if groups and name in groups:
            wanted |= {*groups[name]}
        elif name in (*stages, *optional):
            wanted.add(name)
        else:
            raise ValueError(f"no stage {name!r}: {', '.join((*(groups or ()), *stages, *optional))}")
    return [s for s in (*stages, *optional) if s in wanted]


@dataclass
class Outcome:
    ok: bool = True
    items: int = 0
    error: str | None = None


@dataclass
class Run:
    """Stages run one after the other; one that fails is noted and the others go on."""

    outcomes: dict[str, Outcome] = field(default_factory=dict)

    def stage(self, name: str, work: Callable[[], tuple[int, Sequence[str]]]) -> Outcome:
        """``work`` gives how many items it took and what failed; an error, whatever it is, fails this stage alone."""
        try:
            items, failed = work()
            few = ", ".join(failed[:8]) + (" …" if len(failed) > 8 else "")
            out = Outcome(not failed, items, f"{len(failed)} failed: {few}" if failed else None)
        except Exception as e:  # noqa: BLE001
            out = Outcome(False, 0, f"{type(e).__name__}: {e}"[:200])
        self.outcomes[name] = out
        return out


def months_before(cursor: str | None, start: str, current: str) -> list[str]:
    """The months still to be read backwards from the cursor, or from before the current one, down to ``start``: newest first."""
    number = lambda ym: int(ym[:4]) * 12 + int(ym[5:7]) - 1
    return [f"{m // 12:04d}-{m % 12 + 1:02d}" for m in range(number(cursor or current) - 1, number(start) - 1, -1)]


def resumed(pages: Callable[[int], Sequence | None], cursor: int | None, *, size: int, budget: int, known: Callable[[object], bool] = lambda row: False) -> tuple[list, int | None]:
    """(rows, next page): a paged source read on from its cursor, at most ``budget`` pages; None when it has ended - by a short page, or one
    whose rows are all the last one's again - and the failed page's number where one can't be read, so that none is skipped."""
    rows: list = []
    before: list | None = None
    page = cursor or 1
    for _ in range(budget):
        got = pages(page)
        if got is None:
            return rows, page
        got = list(got)
        if before is not None and got == before:
            return rows, None
        rows += [r for r in got if not known(r)]
        if len(got) < size:
            return rows, None
        before, page = got, page + 1
    return rows, page


def advanced(cursors: DataFrame, seen: DataFrame) -> DataFrame:
    """(source, next, last, done): cursors after a run's pages (source, page, last, ok). A source goes on after its pages read without a gap from
    where it stood; it is done when that was the last. Sources without a page stay; twice is once."""
    at = cursors.select("source", F.col("next").alias("__n"), F.col("last").alias("__l"), F.col("done").alias("__d"))
    rows = seen.join(at.select("source", "__n"), "source", "left").withColumn("__n", F.coalesce("__n", F.lit(1)))
    read = rows.groupBy("source").agg(F.max("last").alias("last"), F.max("__n").alias("n"), F.array_sort(F.collect_set(F.when(F.col("ok") & (F.col("page") >= F.col("__n")), F.col("page")))).alias("pages"))  # a run's few pages
    after = F.aggregate("pages", F.col("n"), lambda n, p: F.when(p == n, n + 1).otherwise(n))
    both = at.join(read.select("source", "last", after.alias("next")), "source", "full")
    last = F.coalesce(F.greatest("last", "__l"), F.lit(1))
    nxt = F.coalesce("next", "__n")
    return both.select("source", nxt.cast("int").alias("next"), last.cast("int").alias("last"), (F.coalesce("__d", F.lit(False)) | (nxt > last)).alias("done"))


def budgeted(wanted: DataFrame, order: Sequence, *, new: str, most_new: int, most_rest: int, hard: int = 400) -> DataFrame:
    """The rows that a run takes on: the first ``most_new`` new ones, then the first ``most_rest`` of all others, together at most ``hard``."""
    from ..operators.ranking import quota

    first = max(0, min(most_new, hard))
    return quota(wanted, F.col(new), first, max(0, min(most_rest, hard - first)), order)


def manual_first(asked: Sequence[str], state: Mapping[str, tuple[bool, int]], *, most: int = 20, fails: int = 3) -> list[str]:
    """The ids that users asked for, once each in order, without those known in full (state: known, failures) or failed too often."""
    return [i for i in dict.fromkeys(asked) if not state.get(i, (False, 0))[0] and state.get(i, (False, 0))[1] < fails][:most]


def no_cursors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CURSOR)


def queue(actions: Sequence[tuple[str, str]], ids: Sequence[str]) -> list[str]:
    """What an assistant shows next after a log of (action, id): linked and skipped ids are out, later ones come last in the order in which they were
    put off, back takes the last action back."""
    log: list[tuple[str, str]] = []
    for action, i in actions:
        if action == "back":
            log = log[:-1]
        else:
            log.append((action, i))
    last = {i: (k, a) for k, (a, i) in enumerate(log)}
    open_ = [i for i in ids if i not in last or last[i][1] == "requeue"]
    later = sorted((i for i in ids if i in last and last[i][1] == "later"), key=lambda i: last[i][0])
    return open_ + later


def batches(rows: int, size: int = 50, most: int = 600) -> int:
    """How many requests an outside service gets for so many rows."""
    return math.ceil(min(rows, most) / size)
