"""Slowly changing (type 2) history: building it, reading it, joining facts to it.

A history table holds one row per version of a key: the source's columns plus ``valid_from`` and
``valid_to``; the version whose ``valid_to`` is NULL is the current one. Intervals are half-open.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampType

from siltstone.functions.values import column, max_literal, surrogate_key
from siltstone.operators import ordered
from siltstone.operators.batches import dedupe_by_key
from siltstone.sinks.staging import stage

FROM, TO = "valid_from", "valid_to"

# Fixed value: end of an open interval in a closed (BETWEEN) comparison.
FAR_FUTURE = "9999-12-31"


def _differs(left: Column, right: Column, names: Iterable[str]) -> Column:
    return reduce(or_, [~left[n].eqNullSafe(right[n]) for n in names])


def _one_row_per_key(source: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _new: struct of all columns); a repeated or NULL key fails the query.

    Counted with a partial aggregate, so even a key repeated endlessly reaches its task pre-combined.
    """
    grouped = source.groupBy(*[column(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("_copies"),
        F.max(F.struct(*[column(c) for c in source.columns])).alias("_row"),
    )
    shown = F.concat_ws(", ", *[F.coalesce(column(k).cast("string"), F.lit("NULL")) for k in keys])
    bad = (F.col("_copies") > 1) | reduce(or_, [column(k).isNull() for k in keys])
    fail = F.raise_error(F.concat(F.lit("snapshot source: key repeated or NULL: "), shown))
    return grouped.select(
        *[column(k) for k in keys], F.when(bad, fail).otherwise(F.col("_row")).alias("_new")
    )


def scd2_snapshot(
    target: DataFrame | None,
    source: DataFrame,
    key: str | list[str],
    check_cols: list[str],
    as_of: datetime | str | Column,
    hard_deletes: str = "ignore",
    first_valid_from: datetime | str | Column | None = None,
    time_type: DataType | None = None,
) -> DataFrame:
    """The history after taking a snapshot of ``source`` at ``as_of``.

    A new key opens a version; a key with any check column changed (NULL-safe) closes its open
    version and opens another; other keys keep the version they have, also when only columns outside
    ``check_cols`` differ. A vanished key stays current, or is closed under
    ``hard_deletes="invalidate"``. Repeating a snapshot changes nothing; a change dated at or before
    the open version it would close fails the query (``scd2_splice`` takes such a snapshot). ``first_valid_from`` back-dates the very first load.

    Closed versions pass through without a shuffle. Open ones meet the source in one full outer join
    on the key, which holds at most one row per key on either side, so it cannot skew.
    """
    keys = [key] if isinstance(key, str) else list(key)
    time_type = target.schema[FROM].dataType if target is not None else time_type or TimestampType()
    moment = (as_of if isinstance(as_of, Column) else F.lit(as_of)).cast(time_type)
    never = F.lit(None).cast(time_type)
    incoming = _one_row_per_key(source, keys)

    if target is None:
        start = moment
        if first_valid_from is not None:
            given = first_valid_from if isinstance(first_valid_from, Column) else F.lit(first_valid_from)
            start = given.cast(time_type)
        opened = incoming.select("_new.*", start.alias(FROM), never.alias(TO))
        return opened

    columns = [*source.columns, FROM, TO]
    closed = target.filter(column(TO).isNotNull()).select(*columns)
    current = target.filter(column(TO).isNull()).select(
        *[column(k).alias(f"_t_{k}") for k in keys], F.struct(*[column(c) for c in columns]).alias("_old")
    )
    same_key = reduce(and_, [column(k) == column(f"_t_{k}") for k in keys])
    old, new = F.col("_old"), F.col("_new")

    changed = old.isNotNull() & new.isNotNull() & _differs(old, new, check_cols)
    gone = old.isNotNull() & new.isNull() & F.lit(hard_deletes == "invalidate")
    stale = F.raise_error(F.lit("snapshot dated at or before the open version it would close"))
    closing = F.when(changed | gone, F.when(moment > old[FROM], moment).otherwise(stale.cast(time_type)))

    kept = F.struct(*[old[c].alias(c) for c in [*source.columns, FROM]], closing.alias(TO))
    opened = F.struct(*[new[c].alias(c) for c in source.columns], moment.alias(FROM), never.alias(TO))
    versions = F.array_compact(
        F.array(F.when(old.isNotNull(), kept), F.when(new.isNotNull() & (old.isNull() | changed), opened))
    )
    current = current.join(incoming, same_key, "full_outer").select(F.explode(versions).alias("_v")).select("_v.*")
    return closed.unionByName(current)


def scd2_splice(
    history: DataFrame,
    taken: DataFrame,
    source: DataFrame,
    key: str | list[str],
    check_cols: list[str],
    as_of: datetime | str | Column,
    hard_deletes: str = "ignore",
) -> DataFrame:
    """The history after taking a snapshot that may be older than others: batches in any order give the history of the sorted order.

    ``taken`` holds the moments (``at``) of all snapshots in the history; one at ``as_of`` itself fails the query. What ``source`` says holds from
    ``as_of`` up to the next snapshot taken, since that saw what the history tells for its moment. So the version around ``as_of`` is closed
    there and, if the next snapshot still saw it, opened again at that one; a version that opens there with equal check columns
    is joined to the new one. Under ``hard_deletes="ignore"`` a key that a later snapshot lacked is taken for unchanged until it is seen again. A
    version opened again repeats the columns of its first part, also those outside ``check_cols``.

    Versions closed by then pass through without a shuffle. Of the others one row per key, combined before it is shuffled, meets the source.
    """
    keys = [key] if isinstance(key, str) else list(key)
    time_type = history.schema[FROM].dataType
    moment = (as_of if isinstance(as_of, Column) else F.lit(as_of)).cast(time_type)
    times = taken.select(column("at").cast(time_type).alias("at"))
    following = max_literal(times.filter(F.col("at") >= moment).agg(F.min("at").alias("at")), "at")
    if following is None:
        return scd2_snapshot(history, source, keys, check_cols, moment, hard_deletes)
    columns = [*source.columns, FROM, TO]
    history = history.select(*columns)
    past, future = history.filter(column(TO) <= moment), history.filter(column(TO).isNull() | (column(TO) > moment))
    row = F.struct(*[column(c) for c in columns])
    around = F.when(column(FROM) <= moment, column(FROM))
    ahead = F.when(column(FROM) > moment, column(FROM))
    known = future.groupBy(*[column(k).alias(f"_t_{k}") for k in keys]).agg(
        F.max_by(row, around).alias("_old"), F.min_by(row, ahead).alias("_then"))
    same_key = reduce(and_, [column(k) == column(f"_t_{k}") for k in keys])
    met = known.join(_one_row_per_key(source, keys), same_key, "full_outer")

    old, new, then = F.col("_old"), F.col("_new"), F.col("_then")
    yes = lambda c: F.coalesce(c, F.lit(False))
    has, came, more = old.isNotNull(), new.isNotNull(), then.isNotNull()
    ends_gone = F.lit(hard_deletes == "invalidate")
    repeated = F.raise_error(F.lit("splice: a snapshot of this moment was taken already")).cast(time_type)
    at = F.when(following == moment, repeated).otherwise(moment)
    opens = came & (~has | yes(_differs(old, new, check_cols)))
    splits = has & (opens | (~came & ends_gone))
    goes_on = has & (old[TO].isNull() | yes(old[TO] > following))
    # Without a version at the next snapshot the key was not seen by it, which ends it or leaves it as it is.
    unseen = ~goes_on & ~yes(then[FROM] == following)
    joins = opens & more & ~goes_on & (~unseen | ~ends_gone) & ~yes(_differs(then, new, check_cols))
    to = F.when(joins, then[TO]).when(unseen & ~ends_gone, then[FROM]).otherwise(following)
    kept = F.struct(*[old[c].alias(c) for c in [*source.columns, FROM]], F.when(splits, at).otherwise(old[TO]).alias(TO))
    opened = F.struct(*[new[c].alias(c) for c in source.columns], at.alias(FROM), to.alias(TO))
    again = F.struct(*[old[c].alias(c) for c in source.columns], following.cast(time_type).alias(FROM), old[TO].alias(TO))
    versions = F.array_compact(F.array(
        F.when(has, kept), F.when(opens, opened), F.when(splits & goes_on, again), F.when(more & ~joins, then)))
    changed = met.select(F.explode(versions).alias("_v")).select("_v.*")
    first = known.select(*[column(f"_t_{k}") for k in keys], then[FROM].alias("_first"))
    later = future.filter(column(FROM) > moment).join(first, same_key).filter(column(FROM) > F.col("_first")).select(*columns)
    return past.unionByName(changed).unionByName(later)


def _changes(part: ordered.Ordered, rows: DataFrame, check_cols: list[str], ts: str) -> DataFrame:
    """Of rows chosen by key and range, those that differ from the row of their key before, or have none."""
    now = F.struct(*[column(c) for c in check_cols])
    compared = ordered.neighbour(part, rows, [ts], now, "_before", -1)
    return compared.filter(F.col("_before").isNull() | _differs(F.col("_before"), now, check_cols)).drop("_before")


def scd2_replay(batches: DataFrame, key: str | list[str], check_cols: list[str], ts: str) -> DataFrame:
    """The history that snapshots of every batch in turn would have built, in one go, where no key vanishes.

    Changes and interval ends are found per key and, for hot keys, per range of (key, time), of which one row crosses to the next. So a
    key with a third of all rows is spread over many tasks, also where they fall on one day. See ``scd2_replay_deletes`` for keys that vanish.
    """
    keys = [key] if isinstance(key, str) else list(key)

    def versions(part: ordered.Ordered) -> DataFrame:
        changes = _changes(part, part.rows, check_cols, ts)
        # What crosses from later ranges belongs to keys that span ranges: only their changes are looked for again.
        ahead = _changes(part, part.deal(part.spanning(part.table)), check_cols, ts) if part.n else None
        return ordered.neighbour(part, changes, [ts], column(ts), TO, 1, ahead)

    rows = _batch_rows(batches, keys, ts)
    ended = ordered.in_order(rows, keys, [ts], versions, counted=batches)
    return ended.withColumnRenamed(ts, FROM).select(*[column(c) for c in batches.columns if c != ts], FROM, TO)


def _batch_rows(batches: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """One row per key and batch; a NULL key or time fails the query."""
    fail = F.raise_error(F.lit("replay: NULL key or time"))
    required = {c: F.coalesce(column(c), fail.cast(batches.schema[c].dataType)) for c in [*keys, ts]}
    return dedupe_by_key(batches.withColumns(required), [*keys, ts])


def scd2_replay_deletes(batches: DataFrame, key: str | list[str], check_cols: list[str], ts: str) -> DataFrame:
    """The history that snapshots of every batch in turn would have built under ``hard_deletes="invalidate"``, in one go.

    The batches of all keys are a calendar. A key's rows fall into islands of batches that follow one another without a gap: in an
    island versions end where the next one opens, and the last one ends with the batch in which the key is first missing. A key that
    comes back opens a version anew, equal to the last one or not. The calendar has one row per batch; its order, and that of each
    batch's successor, are found on it before the rows meet it.
    """
    keys = [key] if isinstance(key, str) else list(key)
    calendar = _calendar(batches, ts)
    rows = _batch_rows(batches, keys, ts).join(calendar, column(ts) == F.col("_at"), "left").drop("_at")
    now = F.struct("_batch", *[column(c) for c in check_cols])
    before, following = F.col("_before"), F.col("_following")
    absent = before.isNull() | (before["_batch"] != F.col("_batch") - 1)
    missing = F.col("_next").isNotNull() & (following.isNull() | (following != F.col("_batch") + 1))
    what = F.struct(column(ts).alias("at"), F.col("_ends").alias("ends"), F.col("_next").alias("next"))

    def versions(part: ordered.Ordered) -> DataFrame:
        compared = ordered.neighbour(part, part.rows, [ts], now, "_before", -1)
        compared = ordered.neighbour(part, compared, [ts], F.col("_batch"), "_following", 1)
        # At one batch a version may open and the key be last seen: the opening stands first, the end is that of the batch after it.
        marks = F.array_compact(F.array(
            F.when(absent | _differs(before, now, check_cols), F.lit(False)), F.when(missing, F.lit(True))))
        marked = compared.withColumn("_ends", F.explode(marks)).withColumn("_turn", F.col("_ends").cast("int"))
        marked = marked.drop("_before", "_following")
        if part.n:
            marked = stage(marked, "marks")
        near = part.spanning(marked) if part.n else None
        return ordered.neighbour(part, part.deal(marked), [ts, "_turn"], what, "_then", 1, near)

    ended = ordered.in_order(rows, keys, [ts], versions, counted=batches)
    then = F.col("_then")
    to = F.when(then["ends"], then["next"]).otherwise(then["at"])
    return ended.filter(~F.col("_ends")).withColumn(TO, to).withColumnRenamed(ts, FROM).select(
        *[column(c) for c in batches.columns if c != ts], FROM, TO)


def _calendar(batches: DataFrame, ts: str) -> DataFrame:
    """(_at, _batch, _next) of every batch: its number and the time of the one after it. One row per batch, ordered in one task."""
    times = batches.select(column(ts).alias("_at")).filter("_at IS NOT NULL").distinct()
    by_time = Window.orderBy("_at")
    return stage(times.select("_at", F.row_number().over(by_time).alias("_batch"), F.lead("_at").over(by_time).alias("_next")), "calendar")


def scd2_dimension(history: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Dimension view of a history: ``{output: input}`` columns, the interval, and ``is_current``."""
    return history.select(
        *[column(c).alias(name) for name, c in columns.items()], FROM, TO, column(TO).isNull().alias("is_current")
    )


def _no_shared_names(fact: DataFrame, dim: DataFrame) -> None:
    shared = sorted(set(fact.columns) & set(dim.columns))
    if shared:
        raise ValueError(f"rename columns that fact and dimension share: {shared}")


def asof_dim_join(
    fact: DataFrame,
    dim: DataFrame,
    on: Mapping[str, str],
    ts: str,
    closed: str = "half",
    how: str = "inner",
) -> DataFrame:
    """Join each fact to the version of its key valid at ``ts``.

    ``closed="half"`` is [from, to): at most one match. ``closed="both"`` is BETWEEN, in which a
    moment on a boundary matches two versions. An equi-join on the key with the interval as a
    residual: right while a key has few versions, whichever side Spark finds small enough to
    broadcast. For keys with long histories use ``asof_merge_join``, whose work does not grow with
    facts times versions.
    """
    _no_shared_names(fact, dim)
    begins, ends = column(FROM), column(TO)
    if closed == "both":
        within = column(ts).between(begins, F.coalesce(ends, F.lit(FAR_FUTURE).cast(dim.schema[TO].dataType)))
    else:
        within = (column(ts) >= begins) & (ends.isNull() | (column(ts) < ends))
    same_key = reduce(and_, [column(f) == column(d) for f, d in on.items()])
    return fact.join(dim, same_key & within, how)


def asof_merge_join(fact: DataFrame, dim: DataFrame, on: Mapping[str, str], ts: str, closed: str = "half") -> DataFrame:
    """``asof_dim_join`` (inner) by ordering facts and versions together instead of pairing them.

    Work is linear in facts plus versions however many versions a key has, and a hot key is spread over ranges of its time (facts of one
    moment too). Needs disjoint intervals per key, which is what snapshots produce.
    """
    _no_shared_names(fact, dim)
    keys = [f"_k{i}" for i in range(len(on))]
    row, version = F.struct(*[column(c) for c in fact.columns]), F.struct(*[column(c) for c in dim.columns])

    # At one moment the version comes first: it is valid from that moment on.
    versions = _sided(dim, keys, list(on.values()), FROM, 0).withColumn("_version", version)
    facts = _sided(fact, keys, list(on), ts, 1).withColumns({"_fact": row, "_tie": F.xxhash64(*[column(c) for c in fact.columns])})
    both = _known(facts, keys).select(*keys, "_at", "_turn", "_tie", "_fact").unionByName(
        _known(versions, keys).select(*keys, "_at", "_turn", "_version"), allowMissingColumns=True)
    matched = _valid_versions(both, keys)
    result = matched.select("_fact.*", "_valid.*")
    if closed == "half":
        return result
    # BETWEEN also matches the version that ends exactly at the fact's moment.
    ending = reduce(and_, [column(f) == column(d) for f, d in on.items()]) & (column(ts) == column(TO))
    return result.unionByName(fact.join(dim, ending))


def _sided(df: DataFrame, keys: list[str], names: list[str], at: str, turn: int) -> DataFrame:
    return df.withColumns({**{k: column(n) for k, n in zip(keys, names)}, "_at": column(at), "_turn": F.lit(turn)})


def _known(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.filter(reduce(and_, [column(k).isNotNull() for k in [*keys, "_at"]]))


def _latest_versions(both: DataFrame, keys: list[str]) -> DataFrame:
    """Facts (turn 1) of a tagged union, each with the latest ``_version`` (turn 0) that began by its moment as ``_valid``, NULL without one."""
    order = ["_at", "_turn"]

    def matched(part: ordered.Ordered) -> DataFrame:
        return ordered.last_known(part, order, "_version", "_valid").filter(F.col("_turn") == 1)

    return ordered.in_order(both, keys, order, matched, ["_tie"])


def _valid_versions(both: DataFrame, keys: list[str]) -> DataFrame:
    """Of these, the facts whose version is still open at their moment."""
    ends = F.col("_valid")[TO]
    return _latest_versions(both, keys).filter(F.col("_valid").isNotNull() & (ends.isNull() | (F.col("_at") < ends)))


def asof_join(fact: DataFrame, dim: DataFrame, on: Mapping[str, str], ts: str, closed: str = "half") -> DataFrame:
    """Inner as-of join of any history: facts and versions are merged in order, however many versions a key has."""
    return asof_merge_join(fact, dim, on, ts, closed)


def versions_at(fact: DataFrame, ts: str, wanted: Sequence[tuple[DataFrame, Mapping[str, str]]]) -> DataFrame:
    """``fact`` with ``_from0``, ``_from1`` …: for each wanted ``(history, {fact column: history key})`` the ``valid_from`` of the version valid at
    ``ts``, NULL without one. Key and ``valid_from`` name a version, so its attributes can be fetched afterwards.

    One tagged union holds the marks of all facts, once per wanted history, and every history's versions, once however often it is
    wanted. One ordered pass over it finds all versions: no fact is paired with a version it does not get. Marks are narrow; the
    facts are written once, numbered, and meet the results by number. A single history is met by the facts themselves.
    """
    if len(wanted) == 1:
        return _version_at(fact, ts, *wanted[0])
    numbered = stage(fact.withColumn("_row", F.monotonically_increasing_id()), "facts")
    groups: dict[tuple, int] = {}
    asked, given = [], []
    for i, (history, on) in enumerate(wanted):
        keys, dims = [f"_k{n}" for n in range(len(on))], list(on.values())
        group = (id(history), *dims)
        types = [history.schema[d].dataType for d in dims]
        facts = numbered.withColumns({k: column(f).try_cast(t) for k, f, t in zip(keys, on, types)})
        facts = facts.withColumns({"_at": column(ts).cast(history.schema[FROM].dataType), "_turn": F.lit(1)})
        if group not in groups:
            groups[group] = len(groups)
            versions = _known(_sided(history, keys, dims, FROM, 0), keys).withColumn("_version", F.struct(FROM, TO))
            given.append(_spelled(versions, keys).select(F.lit(groups[group]).alias("_group"), "_key", "_at", "_turn", "_version"))
        asked.append(_spelled(_known(facts, keys), keys).select(
            F.lit(groups[group]).alias("_group"), "_key", "_at", "_turn", F.col("_row").alias("_tie"), F.lit(i).alias("_wanted")))
    # Written once, as they are counted before they are ordered; they are narrow.
    given = [stage(reduce(DataFrame.unionByName, given), "versions")]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*asked, *given])
    found = _valid_versions(both, ["_group", "_key"]).select("_tie", "_wanted", F.col("_valid")[FROM].alias("_from"))
    names = [f"_from{i}" for i in range(len(wanted))]
    by_row = found.groupBy("_tie").agg(*[F.max(F.when(F.col("_wanted") == i, F.col("_from"))).alias(n) for i, n in enumerate(names)])
    joined = numbered.join(by_row, F.col("_row") == F.col("_tie"), "left")
    exact = [F.col(n).cast(history.schema[FROM].dataType).alias(n) for n, (history, _) in zip(names, wanted)]
    return joined.select(*[column(c) for c in fact.columns], *exact)


def _version_at(fact: DataFrame, ts: str, history: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """``versions_at`` for one history: facts go through the ordered pass whole, and those without a key or time past it."""
    keys, time_type = [f"_k{i}" for i in range(len(on))], history.schema[FROM].dataType
    asked = fact.withColumns({k: column(f).try_cast(history.schema[d].dataType) for k, (f, d) in zip(keys, on.items())})
    asked = asked.withColumns({
        "_at": column(ts).cast(time_type), "_turn": F.lit(1), "_fact": F.struct(*[column(c) for c in fact.columns]),
        "_tie": F.xxhash64(*[column(c) for c in fact.columns])})
    versions = _known(_sided(history, keys, list(on.values()), FROM, 0), keys).withColumn("_version", F.struct(FROM, TO))
    both = _known(asked, keys).select(*keys, "_at", "_turn", "_tie", "_fact").unionByName(
        versions.select(*keys, "_at", "_turn", "_version"), allowMissingColumns=True)
    valid, open_at = F.col("_valid"), F.col("_valid")[TO].isNull() | (F.col("_at") < F.col("_valid")[TO])
    found = _latest_versions(both, keys).select("_fact.*", F.when(valid.isNotNull() & open_at, valid[FROM]).alias("_from0"))
    whole = reduce(and_, [column(k).isNotNull() for k in [*keys, "_at"]])
    past = asked.filter(~whole).select(*[column(c) for c in fact.columns], F.lit(None).cast(time_type).alias("_from0"))
    return found.unionByName(past)


def _spelled(df: DataFrame, keys: list[str]) -> DataFrame:
    """With ``_key``: the keys as one text, so that histories with keys of any type share a column."""
    texts = [column(k).cast("string") for k in keys]
    return df.withColumn("_key", texts[0] if len(texts) == 1 else F.to_json(F.array(*texts)))


def resolve_surrogate(
    fact: DataFrame, dim: DataFrame, on: Mapping[str, str], ts: str, name: str = "dim_sk"
) -> DataFrame:
    """Facts with the surrogate key of the version valid at ``ts``; facts without one get NULL."""
    found = versions_at(fact, ts, [(dim, on)])
    return found.select(*[column(c) for c in fact.columns], version_surrogate(dim, on, "_from0").alias(name))


def version_surrogate(history: DataFrame, on: Mapping[str, str], valid_from: str) -> Column:
    """The surrogate key of a version, from the fact's own key columns (as the history spells them) and the version's start."""
    keys = [column(f).try_cast(history.schema[d].dataType) for f, d in on.items()]
    return F.when(column(valid_from).isNotNull(), surrogate_key(*keys, column(valid_from)))
