"""One surviving record for each group of fetches of the same release.

Groups are found in stages, each linear in its input:

1. Texts of one page meet in what they share: a run of twelve words behind the age that a report names (it doesn't
   depend on what stands before the report, nor on where it was cut off), three numbers in a row from anywhere in
   the text, or the release's number. Sharing alone links nothing.
2. Texts that meet are compared whole. They are linked if they agree in four fifths of the shorter one's words and in
   all its numbers but one (in all, if only the release's number brought them together). Each is compared with the
   longest of those it meets; those unlike it with the longest among themselves, and so on until none is left.
3. Records without a usable text join the cluster of their page and number that shares their title or
   day; without title and day they join only if there is a single cluster. A number alone never
   merges two texts, so a number given out twice stays two releases.
4. Records still alone join a cluster of their page by title and day, if the number is missing or one
   slip away.

The surviving title and text come from a token-level consensus: a group's values are aligned
progressively, tokens vote per column with the number of records that carry them, and each existing
value is measured against the consensus. Values that end before it, or say that they go on, are cut
short; those farther than ``FAR_OFF`` from it don't belong. Of the rest the one fetched last survives.

A group may hold a third of all rows. Equal values are counted first, a consensus is built over at most
``PART`` distinct values at a time and then over the results, and every value is judged on its own.

Defined results: NULL, empty and stub values never survive; if no value of a group is whole, its id is
NULL. Repeated records count with their number; ties in ``fetched_at`` go to the smaller ``rec_id``.
Records without a page number form no group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wachbuch.functions.text import page_number, release_number, squeeze
from wachbuch.llm.normal import fold, unmangle, words
from wachbuch.operators import timestamps
from wachbuch.operators.components import components, sizeless
from wachbuch.session import cut

#: What stands in a title or text that has none, folded.
TITLE_STUBS = ("", "-", "k. a.", "ohne titel", "meldung der polizei", "pressemitteilung", "entwurf", "n. n.", "unbekannt", "titel folgt")
TEXT_STUBS = ("", "-", "k. a.", "text folgt.", "inhalt wird geladen ...", "diese seite ist derzeit nicht verfuegbar.", "entwurf")
#: What a later fetch may append to a whole title.
TAILS = (" (Nachtrag)", ", Zeugen gesucht", " – aktualisiert")
#: Fixed value: what a later fetch may put before a title, folded.
HEAD = "^korrektur: "
RUN = 12
PART = 64
FAR_OFF = 0.5
_MARK = re.compile(r"(?:\[\s*(?:\.\.\.|…)\s*\]|…|\.\.\.)\s*$")


def _tail_pattern() -> str:
    return "(?:" + "|".join(re.escape(t) for t in TAILS) + r")+$"


def features(press: DataFrame) -> DataFrame:
    """One row per record: what grouping looks at."""
    d = press.select("rec_id", "pm_id", "title", "text", "source_url", "zeit_raw", "publish_date")
    d = timestamps.normalize(timestamps.normalize(d, "zeit_raw", prefix="z_"), "publish_date", prefix="d_")
    text, title = fold(unmangle(F.col("text"))), fold(unmangle(F.col("title")))
    d = d.select(
        F.col("rec_id").cast("long").alias("rec"),
        page_number(F.col("source_url")).alias("page"),
        release_number(F.col("pm_id")).alias("no"),
        F.when(~F.coalesce(text, F.lit("")).isin(*TEXT_STUBS), words(text)).alias("w"),
        F.when(~F.coalesce(title, F.lit("")).isin(*TITLE_STUBS), F.array_join(words(F.regexp_replace(F.regexp_replace(title, _tail_pattern().lower(), ""), HEAD, "")), " ")).alias("t"),
        F.coalesce(F.col("z_day"), F.lit(None).cast("date")).cast("string").alias("z"),
        F.col("d_day").cast("string").alias("d"),
    )
    return cut(d.where("rec is not null and page is not null"))


def _runs(w: Column) -> Column:
    """Hashes of the runs of words that make a report's opening recognisable."""
    at = F.try_element_at(F.filter(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.element_at(w, i).rlike(r"^\d{2}$") & F.coalesce(F.try_element_at(w, i + 1), F.lit("")).rlike("^(?:jaehrig|jahre)")), F.lit(1))
    at = F.coalesce(at, F.lit(4))
    # from the age on, where place and day follow; what stands before it is the same in many reports
    starts = F.array(at, at + 3, at + 7)
    runs = F.transform(starts, lambda s: F.slice(w, s, RUN))
    # the age goes with every run, since a later one may hold neither day nor place
    return F.array_distinct(F.transform(F.filter(runs, lambda r: F.size(r) >= RUN - 2), lambda r: F.xxhash64(F.get(w, at - 1), r)))


def _meeting(w: Column) -> Column:
    """Hashes of what makes a text meet others: its opening's runs, and each three numbers in a row of the whole text."""
    numbers = F.filter(w, lambda x: x.rlike(r"\d"))
    rows = F.transform(F.sequence(F.lit(1), F.greatest(F.size(numbers) - 2, F.lit(1))), lambda k: F.slice(numbers, k, 3))
    return F.array_union(_runs(w), F.transform(F.filter(rows, lambda r: F.size(r) == 3), lambda r: F.xxhash64(F.lit("numbers"), r)))


def _linked(told: DataFrame) -> DataFrame:
    """``a, b``: texts of one release, each with the longest text that it meets and is like."""
    # the number alone is a weak reason to meet, so what meets by nothing else must agree in every number
    keys = F.concat(
        F.transform(_meeting(F.col("w")), lambda k: F.struct(F.xxhash64("page", k).alias("key"), F.lit(1).alias("slips"))),
        F.when(F.col("no").isNotNull(), F.array(F.struct(F.xxhash64("page", F.lit("no"), "no").alias("key"), F.lit(0).alias("slips")))).otherwise(F.array()),
    )
    rest = cut(told.select("rec", F.size("w").alias("n"), F.explode(keys).alias("k")).select("rec", "n", "k.key", "k.slips"))
    body = told.select("rec", "w")
    # the last word may be cut off
    numbers = lambda of: F.filter(F.slice("w", 1, F.size("w") - 1), lambda x: x.rlike(of))
    unlike = lambda of: F.size(F.array_except(numbers(of), F.col("bw")))
    # ages and days must be the same: reports follow patterns and share their other words
    same = F.when(F.col("slips") == 0, unlike(r"^\d+$") == 0).otherwise(unlike(r"\d") <= 1)
    alike = (F.size(F.array_intersect("w", "bw")) >= 0.8 * F.least(F.size(F.array_distinct("w")), F.size(F.array_distinct("bw")))) & same
    linked = None
    while True:
        # the longest text of each key that is shared at all
        longest = rest.groupBy("key").agg(F.max(F.struct("n", (-F.col("rec")).alias("k"))).alias("b"), F.count("*").alias("m")).where("m > 1").select("key", (-F.col("b.k")).alias("a"))
        met = cut(rest.join(longest, "key").where("rec <> a"))
        pairs = met.groupBy("rec", "a").agg(F.max("slips").alias("slips"))
        one = pairs.join(body, "rec").join(body.select(F.col("rec").alias("a"), F.col("w").alias("bw")), "a")
        one = cut(one.select("rec", "a", alike.alias("alike")))
        found = one.where("alike").select("a", F.col("rec").alias("b"))
        linked = found if linked is None else linked.unionByName(found)
        # a page may take as many rounds as it has releases
        rest = sizeless(cut(met.join(one.where("not alike").select("rec", "a"), ["rec", "a"]).select("rec", "n", "key", "slips")))
        if not rest.limit(1).count():
            return linked
        body = cut(body.join(rest.select("rec").distinct(), "rec", "left_semi"))


def _marks(d: DataFrame) -> DataFrame:
    """What two records of one page and number may agree in, with the weight of such an agreement."""
    m = F.array(
        F.struct(F.concat(F.lit("t"), F.col("t")).alias("mark"), F.lit(2.0).alias("v")),
        F.struct(F.concat(F.lit("s"), F.left("t", F.lit(12))).alias("mark"), F.lit(1.0).alias("v")),
        F.struct(F.concat(F.lit("z"), F.col("z")).alias("mark"), F.lit(1.0).alias("v")),
        F.struct(F.concat(F.lit("d"), F.col("d")).alias("mark"), F.lit(1.0).alias("v")),
        F.struct(F.lit("n").alias("mark"), F.lit(0.25).alias("v")),
    )
    return d.withColumn("m", F.explode(m)).withColumns({"mark": F.col("m.mark"), "v": F.col("m.v")}).where("mark is not null").drop("m")


def groups(f: DataFrame) -> DataFrame:
    """``rec, g``: each record with the smallest record of its release."""
    told = f.where("w is not null and size(w) > 2").select("rec", "page", "no", "w")
    c = components(_linked(told))
    text = told.select("rec").join(c.withColumnRenamed("node", "rec"), "rec", "left").select("rec", F.coalesce("root", "rec").alias("g"))

    # records without a text: votes of title and day for a cluster of the same page and number
    all_f = cut(f.withColumn("told", F.coalesce(F.size("w") > 2, F.lit(False))).drop("w").join(text, "rec", "left"))
    mute = all_f.where("not told").drop("g")
    of_text = _marks(all_f.where("told and no is not null")).select("page", "no", "mark", "g").distinct()
    votes = _marks(mute.where("no is not null").withColumn("blank", F.col("t").isNull() & F.col("z").isNull() & F.col("d").isNull()))
    votes = votes.select("rec", "page", "no", "mark", "v", "blank").join(of_text, ["page", "no", "mark"])
    votes = votes.groupBy("rec", "blank", "g").agg(F.sum("v").alias("v"))
    chosen = votes.groupBy("rec", "blank").agg(F.max(F.struct("v", (-F.col("g")).alias("k"))).alias("b"), F.count("*").alias("n"))
    chosen = chosen.where("b.v >= 1 or (blank and n = 1)").select("rec", (-F.col("b.k")).alias("g"))

    # the others among themselves: same page and number, same title opening or day
    own = _marks(mute.where("no is not null")).where("mark <> 'n'").select("rec", "page", "no", "mark")
    own = own.join(own.groupBy("page", "no", "mark").agg(F.min("rec").alias("a")), ["page", "no", "mark"]).groupBy("rec").agg(F.min("a").alias("own"))
    placed = mute.join(chosen, "rec", "left").join(own, "rec", "left")
    placed = cut(placed.withColumns({"found": F.col("g").isNotNull(), "g": F.coalesce("g", "own", "rec")}).drop("own"))

    # by title and day where the number is missing or mistyped
    both = F.concat_ws("|", "t", F.coalesce("z", "d"))
    usable = F.col("t").isNotNull() & (F.length("t") > 12) & F.coalesce("z", "d").isNotNull()
    settled = all_f.where("told").select("page", "no", "t", "z", "d", "g").unionByName(placed.where("found").select("page", "no", "t", "z", "d", "g"))
    there = settled.where(usable).select("page", both.alias("key"), "g", F.col("no").cast("string").alias("no_b")).distinct()
    here = placed.where("not found").where(usable).select(F.col("g").alias("mine"), "page", both.alias("key"), F.col("no").cast("string").alias("no_a"))
    near = here.join(there, ["page", "key"]).where("no_a is null or no_b is null or (length(no_a) = length(no_b) and levenshtein(no_a, no_b) <= 2)")
    near = near.groupBy("mine").agg(F.min("g").alias("to"), F.count_distinct("g").alias("n")).where("n = 1").select(F.col("mine").alias("g"), "to")
    mutes = placed.join(near, (placed["g"] == near["g"]) & ~placed["found"], "left").select("rec", F.coalesce("to", placed["g"]).alias("g"))
    every = all_f.where("told").select("rec", "g").unionByName(mutes)
    # named after the smallest record, which may be one without a text
    low = every.groupBy("g").agg(F.min("rec").alias("low"), F.count("*").alias("n"))
    return cut(every.join(low, "g").select("rec", F.col("low").alias("g"), "n"))


# -- consensus ---------------------------------------------------------------------------------


def align(profile: list[dict[str, float]], tokens: list[str]) -> list[int]:
    """Columns of the profile that the tokens go to; -1 for a token that needs a new column.

    A token may meet a column that already has it (3), one with another token (0, a substitution),
    or stay apart; gaps cost 1.
    """
    n, m = len(profile), len(tokens)
    lo = 0
    while lo < min(n, m) and tokens[lo] in profile[lo]:
        lo += 1
    if lo == m:
        return list(range(m))
    hi = 0
    while hi < min(n, m) - lo and tokens[m - 1 - hi] in profile[n - 1 - hi]:
        hi += 1
    a, b = profile[lo : n - hi], tokens[lo : m - hi]
    h, w = len(a), len(b)
    score = [[0] * (w + 1) for _ in range(h + 1)]
    for i in range(h + 1):
        for j in range(w + 1):
            if i and j:
                score[i][j] = max(score[i - 1][j - 1] + (3 if b[j - 1] in a[i - 1] else 0), score[i - 1][j] - 1, score[i][j - 1] - 1)
            else:
                score[i][j] = -(i + j)
    middle = [-1] * w
    # columns behind the last token cost nothing if the value simply ends there; the earliest end is taken
    i = h if hi else max(range(h + 1), key=lambda k: (score[k][w], -k))
    j = w
    while i and j:
        if score[i][j] == score[i - 1][j - 1] + (3 if b[j - 1] in a[i - 1] else 0):
            middle[j - 1] = lo + i - 1
            i, j = i - 1, j - 1
        elif score[i][j] == score[i - 1][j] - 1:
            i -= 1
        else:
            j -= 1
    return [*range(lo), *middle, *range(n - hi, n)]


def consensus(values: list[tuple[list[str], float]]) -> list[str]:
    """Majority token of each column of a progressive alignment, longest value first.

    Behind its last token a value has no vote: it may have been cut off there.
    """
    values = sorted(values, key=lambda v: (-len(v[0]), v[0]))
    cols: list[dict[str, float]] = [{t: values[0][1]} for t in values[0][0]]
    for tokens, weight in values[1:]:
        to = align(cols, tokens)
        last = max(to, default=-1)
        filled = set(to)
        for k in range(last + 1):
            if k not in filled:
                cols[k][""] = cols[k].get("", 0) + weight
        out: list[dict[str, float]] = []
        at = 0
        for t, k in zip(tokens, to, strict=True):
            if k < 0:
                # a column of its own, in which all earlier values have a gap
                out.append({t: weight, "": sum(cols[0].values()) - weight if cols else 0})
            else:
                out += cols[at : k + 1]
                out[-1][t] = out[-1].get(t, 0) + weight
                at = k + 1
        cols = out + cols[at:]
    # ties go to a token before a gap, and to the token of the longer value
    best = (max(c.items(), key=lambda x: (x[1], x[0] != ""))[0] for c in cols)
    return [t for t in best if t]


def _tokens(text: str) -> list[str]:
    return _MARK.sub("", text).split()


def judge(value: str, whole: str, is_text: bool) -> tuple[bool, float]:
    """Whether a value is whole, and its distance from the consensus (0 equal, 1 nothing in common)."""
    tokens, target = _tokens(value), whole.split()
    if not tokens:
        return False, 1.0
    to = align([{t: 1.0} for t in target], tokens)
    same = sum(1 for t, k in zip(tokens, to, strict=True) if k >= 0 and target[k] == t)
    distance = 1 - same / max(1, len(tokens))
    ended = max(to, default=-1) >= len(target) - 1 or same == 0
    if _MARK.search(value):
        return False, distance
    if is_text:
        ended = ended and value.rstrip()[-1:] in ".!?)“\"" and len(tokens) >= len(target) - max(2, len(target) // 10)
    return ended, distance


_TAIL = re.compile(_tail_pattern())
_VALUE = pa.schema([("g", pa.int64()), ("field", pa.string()), ("value", pa.string()), ("weight", pa.float64())])


def _consensus_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for vs in b.column("vs").to_pylist():
            if len(vs) == 1:
                out.append(" ".join(_tokens(vs[0]["value"])))
            else:
                out.append(" ".join(consensus([(_tokens(v["value"]), v["weight"]) for v in vs])))
        yield pa.RecordBatch.from_arrays([b.column("g"), b.column("field"), pa.array(out, pa.string()), b.column("weight")], schema=_VALUE)


def _judge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("g", pa.int64()), ("field", pa.string()), ("at", pa.timestamp("us")), ("rec", pa.int64()), ("whole", pa.bool_()), ("distance", pa.float64())])
    for b in batches:
        got = [judge(v, c, f == "text") for v, c, f in zip(b.column("value").to_pylist(), b.column("best").to_pylist(), b.column("field").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("g"), b.column("field"), b.column("at"), b.column("rec"), pa.array([x[0] for x in got], pa.bool_()), pa.array([x[1] for x in got], pa.float64())], schema=schema)


def survivors(press: DataFrame, grouped: DataFrame) -> DataFrame:
    """``group_rec_id, title_rec_id, text_rec_id`` of the groups of at least two records."""
    members = grouped.where("n > 1").select("rec", "g")
    many = members.select("g").distinct()
    src = press.select(F.col("rec_id").cast("long").alias("rec"), F.col("fetched_at").cast("timestamp_ntz").alias("at"), "title", "text")
    rows = members.join(src, "rec").withColumn("f", F.explode(F.array(F.struct(F.lit("title").alias("field"), F.col("title").alias("raw")), F.struct(F.lit("text").alias("field"), F.col("text").alias("raw")))))
    rows = rows.select("g", "rec", "at", "f.field", squeeze(unmangle(F.col("f.raw"))).alias("value"))
    low = fold(F.col("value"))
    rows = rows.where(F.when(F.col("field") == "title", ~low.isin(*TITLE_STUBS)).otherwise(~low.isin(*TEXT_STUBS)))
    # what a later fetch appended to a title takes no part in the vote
    rows = rows.withColumn("value", F.when(F.col("field") == "title", F.regexp_replace("value", _tail_pattern(), "")).otherwise(F.col("value")))
    kept = rows.groupBy("g", "field", "value").agg(F.count("*").cast("double").alias("weight"), F.max(F.struct("at", (-F.col("rec")).alias("k"))).alias("last"))
    kept = cut(kept.select("g", "field", "value", "weight", F.col("last.at").alias("at"), (-F.col("last.k")).alias("rec")))
    level = kept.select("g", "field", "value", "weight")
    largest = level.groupBy("g", "field").count().agg(F.max("count")).first()[0] or 0
    while True:
        parts = max(1, -(-largest // PART))
        # values of a group are dealt to parts by hash, so that no list is much longer than PART
        key = F.pmod(F.xxhash64("value"), F.lit(parts)).cast("int") if parts > 1 else F.lit(0)
        lists = level.withColumn("part", key).groupBy("g", "field", "part").agg(F.collect_list(F.struct("value", "weight")).alias("vs"), F.sum("weight").alias("weight"))
        level = lists.select("g", "field", "vs", "weight").mapInArrow(_consensus_batches, "g long, field string, value string, weight double")
        if parts == 1:
            break
        level = cut(level)
        largest = level.groupBy("g", "field").count().agg(F.max("count")).first()[0]
    judged = kept.join(level.select("g", "field", F.col("value").alias("best")), ["g", "field"]).select("g", "field", "at", "rec", "value", "best")
    judged = judged.mapInArrow(_judge_batches, "g long, field string, at timestamp_ntz, rec long, whole boolean, distance double")
    fit = judged.where(f"whole and distance <= {FAR_OFF}").groupBy("g").agg(
        *[(-F.max(F.when(F.col("field") == x, F.struct("at", (-F.col("rec")).alias("k"))))["k"]).alias(f"{x}_rec_id") for x in ("title", "text")]
    )
    return many.join(fit, "g", "left").select(F.col("g").alias("group_rec_id"), "title_rec_id", "text_rec_id")


def found(press: DataFrame) -> DataFrame:
    """p2_found."""
    return survivors(press, groups(features(press)))
