"""URL filters by dated lists: entries become validity intervals, captures are judged as of their fetch time.

All of it is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import stored

# Limits of a short list of keys; judging has none.
PARENTS = 4
FOLDERS = 2

# Fixed value: scheme, user, host, port and the rest of a URL.
_URL = r"^(?i)(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::[0-9]*)?([^?#]*)"


def host_of(url: str | Column) -> Column:
    """Lower-case host without a closing dot; null where there is none."""
    url = F.trim(F.col(url) if isinstance(url, str) else url)
    return F.nullif(F.rtrim(F.lower(F.regexp_extract(url, _URL, 1)), F.lit(".")), F.lit(""))


def keys_of(url: str | Column, parents: int | None = PARENTS, folders: int | None = FOLDERS) -> Column:
    """What list entries may say of a URL: its host, the domains above it (``parents`` at most, two labels at least),
    and the host with the first one to ``folders`` folders of its path; None sets no limit."""
    column = F.trim(F.col(url) if isinstance(url, str) else url)
    host = host_of(url)
    labels = F.split(host, r"\.")
    path = F.filter(F.split(F.regexp_extract(column, _URL, 2), "/"), lambda p: p != "")
    above = _up_to(
        F.size(labels) - 2,
        parents,
        lambda i: F.array_join(F.slice(labels, i + 1, F.greatest(F.size(labels), F.lit(1))), "."),
    )
    below = _up_to(F.size(path), folders, lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(path, 1, i), "/")))
    return F.array_distinct(F.array_compact(F.concat(F.array(host), above, below)))


def _labels(host: Column) -> Column:
    return F.split(host, r"\.")


def _depths(entries: DataFrame) -> tuple[list[int], list[int]]:
    """How many labels the listed domains have, and how many folders the listed folders: one number per depth."""
    path = F.size(F.split("entry", "/")) - 1
    kinds = entries.select(path.alias("folders"), F.when(path == 0, F.size(_labels(F.col("entry")))).alias("labels")).distinct()
    found = kinds.collect()
    return sorted({r.labels for r in found if r.labels}), sorted({r.folders for r in found if r.folders})


def keys_at(url: str | Column, labels: list[int], folders: list[int]) -> Column:
    """The host, its domains of ``labels`` labels (two at least), and its paths of ``folders`` folders.

    A URL is cut once per depth that is asked for and not once per depth that it has, so long ones cost no more than
    their length times the depths.
    """
    column = F.trim(F.col(url) if isinstance(url, str) else url)
    host = host_of(url)
    own = _labels(host)
    path = F.filter(F.split(F.regexp_extract(column, _URL, 2), "/"), lambda p: p != "")
    numbers = lambda ns: F.array(*[F.lit(n) for n in ns]).cast("array<int>")
    wanted = F.filter(numbers([n for n in labels if n > 1]), lambda n: n < F.size(own))
    above = F.transform(wanted, lambda n: F.array_join(F.slice(own, -n, n), "."))
    reached = F.filter(numbers(folders), lambda n: n <= F.size(path))
    below = F.transform(reached, lambda n: F.concat(host, F.lit("/"), F.array_join(F.slice(path, 1, n), "/")))
    return F.when(host.isNotNull(), F.concat(F.array(host), above, below))


def _up_to(count: Column, most: int | None, text: Callable[[Column], Column]) -> Column:
    """``text`` of 1 to ``count``, or to ``most`` if that is less; empty where the count is null or below 1."""
    count = count if most is None else F.least(count, F.lit(most))
    # a sequence would count down from 1 to 0
    return F.when(count >= 1, F.transform(F.sequence(F.lit(1), count), text)).otherwise(F.array().cast("array<string>"))


def moments(entries: DataFrame) -> DataFrame:
    """``(list, entry, since, action)``, one row for each moment at which an entry's state is spoken of.

    ``since`` counts as it is, a date from its midnight and a timestamp from its time of day, and texts are read as
    timestamps. Of several actions at one moment the add counts. Rows with a null list, entry or date, or with another
    action, say nothing.
    """
    known = entries.where("list IS NOT NULL AND entry IS NOT NULL AND since IS NOT NULL AND action IN ('add', 'remove')")
    dated = dict(entries.dtypes)["since"] in ("date", "timestamp", "timestamp_ntz")
    since = F.col("since") if dated else F.col("since").cast("timestamp_ntz").alias("since")
    return known.select("list", "entry", since, "action").groupBy("list", "entry", "since").agg(F.min("action").alias("action"))


def _block(time: str | Column) -> Column:
    """The month in which a time falls, counted from year 0."""
    return (F.year(time) * 12 + F.month(time)).cast("int")


def _states(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An entry's history by months: ``(list, entry, months)`` with the last action of each month in which there is one, and
    ``(list, entry, month, changes)`` with those in the month. A month's changes are sorted by themselves, so the history
    of one entry is no task's."""
    known = moments(entries).withColumn("month", _block("since"))
    inside = known.groupBy("list", "entry", "month").agg(F.array_sort(F.collect_list(F.struct("since", "action"))).alias("changes"))
    last = inside.select("list", "entry", F.struct("month", F.element_at("changes", -1)["action"].alias("action")).alias("m"))
    return last.groupBy("list", "entry").agg(F.array_sort(F.collect_list("m")).alias("months")), inside


def intervals(entries: DataFrame) -> DataFrame:
    """``(list, entry, valid_from, valid_to)`` from dated rows ``(list, entry, since, action)``, read as ``moments`` says.

    An ``add`` opens an interval unless one is open, a ``remove`` closes it; ``valid_to`` is exclusive and null while
    open. The intervals of one entry are put in order by one task; ``judge`` needs no such order.
    """
    history = Window.partitionBy("list", "entry").orderBy("since")
    changes = moments(entries).withColumn("__was", F.lag("action", 1, "remove").over(history)).where("action <> __was")
    ends = changes.withColumn("valid_to", F.lead("since").over(history))
    return ends.where("action = 'add'").select("list", "entry", F.col("since").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """``captures`` with ``matches``: the sorted ``list:entry`` texts that were valid at the fetch time, empty if none.

    An entry may be the host, any domain above it, or the host with any number of the path's first folders. Captures
    that agree in URL and time are judged once, by keys at the depths that the lists have. The as-of join goes by months:
    a capture's key meets one row per list with the last action of each month, and one with the changes of the capture's
    own month; the last change by the fetch time decides, in that month or before it. So it is in an interval that has
    begun and not ended. Both joins are one row to one row however often a host occurs, and a host with very many captures
    is split by the skew join.

    Every capture comes back, repeated rows as often as they came. A null or unreadable URL matches nothing, nor does a
    null fetch time. A column ``matches`` of ``captures`` is replaced; ``__`` columns are dropped.
    """
    kept = [c for c in captures.columns if not c.startswith("__") and c != "matches"]
    asked = captures.select(F.col(url).alias("__url"), F.col(fetched).alias("__at")).where("__at IS NOT NULL").distinct()
    months, inside = (stored(t, "list-history") for t in _states(entries))
    keys = asked.select("__url", "__at", _block("__at").alias("month"), F.explode(keys_at("__url", *_depths(months))).alias("entry"))
    listed = keys.join(months, "entry").join(inside, ["list", "entry", "month"], "left")
    begun = F.filter("changes", lambda c: c["since"] <= F.col("__at"))
    earlier = F.filter("months", lambda m: m["month"] < F.col("month"))
    action = F.coalesce(F.try_element_at(begun, F.lit(-1))["action"], F.try_element_at(earlier, F.lit(-1))["action"])
    found = listed.where(action == "add")
    matches = found.groupBy("__url", "__at").agg(
        F.array_sort(F.collect_set(F.concat("list", F.lit(":"), "entry"))).alias("matches")
    )
    joined = captures.select(*kept).join(
        matches, (F.col(url) == F.col("__url")) & (F.col(fetched) == F.col("__at")), "left"
    )
    return joined.select(*kept, F.coalesce("matches", F.array().cast("array<string>")).alias("matches"))
