"""Install hooks that begin in one file of a release and end in a later one.

A release's text is its files in order, each ended by a line feed, so a hook whose value is
not closed at the end of a file goes on in the next one.  Files are scanned by themselves; a
hook broken off at a file's end is a row of kind 'tail'.  What such a hook needs to go on is
one of three states: it has its name, its colon too, or its value is open.  A file is one
number: what it does to each state carried into it (the hook ends there, goes on through all
of it, or was none) and the state it leaves.  These numbers are read in order once, however
many broken hooks a release has, and tell which files a hook goes through; the texts of
those files alone are joined, and scanned again from behind a hook that ends there.
"""

from collections.abc import Callable, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions.binding import let
from ..session import materialize

TAIL = "tail"
_EITHER = P.HOOK_TOKEN + "|" + P.HOOK_TAIL
_WHOLE = r"\A(?:" + P.HOOK_TOKEN + ")"

# what a text must begin with to end a hook that has its name (1), its colon (2) or an open value (3), and what all of it must be to carry it on
_SPACE = "[" + P.WHITESPACE + "]*+"
_ENDS = {3: r'\A[^"]*+"', 2: r"\A" + _SPACE + r'"[^"]*+"', 1: r"\A" + _SPACE + ":" + _SPACE + r'"[^"]*+"'}
_GOES_ON = {3: r'\A[^"]*+\z', 2: r"\A" + _SPACE + r'(?:"[^"]*+)?\z', 1: r"\A" + _SPACE + "(?::" + _SPACE + r'(?:"[^"]*+)?)?\z'}


def hooks_and_tail(text: Column) -> Column:
    """Hooks of a text in order, and behind them the one its end breaks off, if there is one."""
    return F.regexp_extract_all(text, F.lit(_EITHER), F.lit(0))


def is_tail(token: Column) -> Column:
    """Whether a token of :func:`hooks_and_tail` is broken off."""
    return ~token.rlike(_WHOLE + r"\z")


def _state(token: Column) -> Column:
    """What a broken hook has: 1 its name, 2 its colon too, 3 an open value; 0 for a whole hook or none."""
    broken = F.when(token.rlike(r'\A"[^"]*"[^"]*"'), 3).when(token.contains(":"), 2).otherwise(1)
    return F.when(token.isNotNull() & is_tail(token), broken).otherwise(0)


def _left(text: Column) -> Column:
    """The state a text leaves that begins outside a hook; without two quotes there is no name in it."""
    last = let(hooks_and_tail(text), lambda found: let(F.get(found, F.size(found) - 1), _state))
    return F.when(text.rlike('"[^"]*"'), last).otherwise(0)


def _behind(text: Column, front: Column) -> Column:
    return F.substring(text, F.length(front) + 1, F.length(text))


def _effect(text: Column) -> Column:
    """What a file does to each state, three bits a state: the state it leaves, 4 more if a carried hook ends in it, 0 if that was none.

    A missing text leaves every state as it is.
    """
    left = {1: F.when(text.contains('"'), 3).when(text.contains(":"), 2).otherwise(1), 2: F.when(text.contains('"'), 3).otherwise(2), 3: F.lit(3)}
    def does(state: int) -> Column:
        goes_on = F.when(text.rlike(_GOES_ON[state]), left[state]).otherwise(0)
        ended = let(F.regexp_extract(text, _ENDS[state], 0), lambda front: F.when(front != "", let(_behind(text, front), _left) + 4).otherwise(goes_on))
        return F.when(text.isNull(), state).otherwise(ended) * F.lit(8**state)

    return reduce(Column.__add__, map(does, _ENDS), _left(text))


def _carried(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, file_ord, _effect) -> the files a hook is carried into: (keys, file_ord, state, origin, ended).

    ``origin`` is the file in which the hook begins; ``ended`` tells whether it ends here.  A
    place that a release has twice is a row of state -1, and says no more.
    """
    schema = T.StructType([*[files.schema[c] for c in (*keys, "file_ord")], T.StructField("state", T.IntegerType()),
                           T.StructField("origin", files.schema["file_ord"].dataType), T.StructField("ended", T.BooleanType())])

    def batches(stream):
        before, state, origin = None, 0, None  # of the row before
        for batch in stream:
            if not batch.num_rows:
                continue
            same = [pc.equal(batch.column(k).slice(1), batch.column(k).slice(0, batch.num_rows - 1)).to_pylist() for k in keys]
            first = [batch.column(k)[0].as_py() for k in keys]
            goes_on = [before is not None and before[:-1] == first, *map(all, zip(*same))]
            at, states, origins, ended = [], [], [], []
            place = before[-1] if before else None
            for i, (on, ord_, effect) in enumerate(zip(goes_on, batch.column("file_ord").to_pylist(), batch.column("_effect").to_pylist())):
                if not on:
                    state = 0
                elif place == ord_:
                    at.append(i), states.append(-1), origins.append(ord_), ended.append(False)
                place = ord_
                does = effect >> 3 * state & 7
                if not state or not does:
                    state, origin = effect & 7, ord_
                    continue
                at.append(i), states.append(state), origins.append(origin), ended.append(does >= 4)
                if does >= 4:
                    state, origin = does - 4, ord_
                else:
                    state = does
            before = [*[batch.column(k)[batch.num_rows - 1].as_py() for k in keys], place]
            taken = batch.take(pa.array(at, pa.int64()))
            named = {c: taken.column(c) for c in (*keys, "file_ord")}
            yield pa.RecordBatch.from_pydict({
                **named, "state": pa.array(states, pa.int32()), "origin": pa.array(origins, named["file_ord"].type), "ended": pa.array(ended, pa.bool_())})

    ordered = files.select(*keys, "file_ord", "_effect").repartition(*keys).sortWithinPartitions(*keys, "file_ord")
    return materialize(ordered.mapInArrow(batches, schema), "carried-hooks")


def join_split_hooks(tokens: DataFrame, files: Callable[[DataFrame], DataFrame], keys: Sequence[str]) -> DataFrame:
    """Tokens without tails, with the hooks that the files of a release make together.

    ``tokens`` (keys, file_ord, kind, pos, token, ...) is a written table; hooks take the place
    where they begin.  ``files`` gives the stripped (keys, file_ord, content) of the releases
    it is asked for, and is only called if there are tails.
    """
    keys = list(keys)
    tails = tokens.where(F.col("kind") == TAIL)
    rest = tokens.where(F.col("kind") != TAIL)
    if tails.isEmpty():
        return rest
    other = [c for c in tokens.columns if c not in (*keys, "file_ord", "kind", "pos", "token")]
    asked = files(tails.select(*keys).distinct()).select(*keys, "file_ord", "content").where(F.col("file_ord").isNotNull())
    text = materialize(asked.withColumn("_effect", _effect(F.col("content"))), "hook-files")
    carried = _carried(text, keys)
    repeated = carried.where("state < 0").select(*keys).distinct()
    if repeated.isEmpty():
        placed, inner, changed = _joined(tails, text, carried, keys)
    else:  # a file that a release holds several times is each of them in turn
        repeated = materialize(repeated, "hook-repeats")
        once = [t.join(repeated, keys, "left_anti") for t in (tails, text, carried)]
        often = [t.join(repeated, keys, "left_semi") for t in (tails, text)]
        parts = zip(_joined(*once, keys), _joined_in_turn(often[0], often[1].drop("_effect"), keys))
        placed, inner, changed = (DataFrame.unionByName(*part) for part in parts)
    hook = F.col("kind").eqNullSafe("hook")
    kept = rest.where(~hook).unionByName(rest.where(hook).join(changed, [*keys, "file_ord"], "left_anti").select(*rest.columns))
    new = inner.unionByName(placed).withColumn("kind", F.lit("hook"))
    if other:
        new = new.join(tails.select(*keys, *other).dropDuplicates(keys), keys)
    return kept.select(*tokens.columns).unionByName(new.select(*tokens.columns))


def _joined(tails: DataFrame, text: DataFrame, carried: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hooks of several files, hooks behind their ends, files in which they end) of releases that hold every file once."""
    whole = carried.join(carried.where("ended").select(*keys, "origin"), [*keys, "origin"], "left_semi")
    step = whole.join(text.select(*keys, "file_ord", "content"), [*keys, "file_ord"])
    front = F.lit(None).cast("string")
    for state, end in _ENDS.items():
        front = F.when(F.col("state") == state, F.regexp_extract("content", end, 0)).otherwise(front)
    step = step.withColumn("piece", F.when(F.col("ended"), front).otherwise(F.col("content")))
    found = F.when(F.col("ended"), hooks_and_tail(_behind(F.col("content"), F.col("piece"))))
    step = materialize(step.select(*keys, "file_ord", "origin", "ended", "piece", found.alias("found")), "hook-pieces")
    behind = step.select(*keys, "file_ord", F.posexplode("found").alias("pos", "token"))
    # a hook begins with the tail of its first file, as it is found behind a hook that ends there or else by itself
    none = F.lit(None)
    begun = tails.select(*keys, F.col("file_ord").alias("origin"), F.struct(F.lit(0).alias("again"), "pos", "token").alias("head"))
    again = behind.where(is_tail(F.col("token"))).select(*keys, F.col("file_ord").alias("origin"), F.struct(F.lit(1).alias("again"), "pos", "token").alias("head"))
    pieces = step.select(*keys, "origin", F.struct("file_ord", "piece").alias("piece"))
    rows = begun.unionByName(again).withColumn("piece", none).unionByName(pieces.withColumn("head", none))
    runs = rows.groupBy(*keys, "origin").agg(F.max("head").alias("head"), F.sort_array(F.collect_list("piece")).alias("pieces")).where(F.size("pieces") > 0)
    placed = runs.select(*keys, F.col("origin").alias("file_ord"), F.col("head.pos").alias("pos"), F.concat_ws("\n", "head.token", "pieces.piece").alias("token"))
    inner = behind.where(~is_tail(F.col("token")))
    return placed, inner, step.where("ended").select(*keys, "file_ord")


def _joined_in_turn(tails: DataFrame, text: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same for releases that hold a file several times: a round carries the first tail of every release one file on."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("file_ord"))
    text = materialize(text.join(text.select(*keys, "file_ord").withColumn("seq", place), [*keys, "file_ord"]), "hook-files")
    open_ = tails.join(text.select(*keys, "file_ord", "seq"), [*keys, "file_ord"]).select(
        *keys, "seq", F.col("file_ord").alias("at_ord"), F.col("pos").alias("at_pos"), F.col("token").alias("carried")
    )
    open_ = materialize(open_, "open-hooks")
    ended, scanned = [], []
    while not open_.isEmpty():
        first = open_.groupBy(*keys).agg(F.min("seq").alias("seq"))
        heads = open_.join(first, [*keys, "seq"]).withColumn("seq", F.col("seq") + 1)
        joined = heads.join(text, [*keys, "seq"]).withColumn("all", F.concat_ws("\n", "carried", "content"))
        hook = F.regexp_extract("all", _WHOLE, 0)
        step = joined.withColumn("hook", hook).withColumn("goes_on", F.col("all").rlike(r"\A(?:" + P.HOOK_TAIL + ")"))
        found = hooks_and_tail(F.substring(F.col("all"), F.length("hook") + 1, F.length("all")))
        step = step.withColumn("found", F.when(F.col("hook") != "", found).otherwise(F.array().cast("array<string>")))
        step = materialize(step.select(*keys, "seq", "file_ord", "at_ord", "at_pos", "all", "hook", "goes_on", "found"), "carried-hooks")
        taken = step.where("hook <> '' OR goes_on")
        ended.append(step.where("hook <> ''").select(*keys, F.col("at_ord").alias("file_ord"), F.col("at_pos").alias("pos"), F.col("hook").alias("token")))
        again = taken.select(*keys, "file_ord", "seq", F.posexplode_outer("found").alias("pos", "token"))
        again = materialize(again, "scanned-hooks")
        scanned.append(again)
        fresh = again.where(is_tail(F.col("token"))).select(
            *keys, "seq", F.col("file_ord").alias("at_ord"), F.col("pos").alias("at_pos"), F.col("token").alias("carried")
        )
        on = step.where("hook = '' AND goes_on").select(*keys, "seq", "at_ord", "at_pos", F.col("all").alias("carried"))
        left = open_.join(first, [*keys, "seq"], "left_anti")
        left = left.join(taken.select(*keys, "seq"), [*keys, "seq"], "left_anti")
        open_ = materialize(left.unionByName(fresh).unionByName(on), "open-hooks")
    placed, changed = reduce(DataFrame.unionByName, ended), reduce(DataFrame.unionByName, scanned)
    inner = changed.where(F.col("token").isNotNull() & ~is_tail(F.col("token"))).select(*keys, "file_ord", "pos", "token")
    return placed, inner, changed.select(*keys, "file_ord").distinct()
