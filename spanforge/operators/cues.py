"""Captions from timed words: the segmentation of least cost over all places to break, and lines of even length."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table, turns

# Characters of a line, a pause that parts captions, the longest time of one, how long it stays after
# its last word, the least time it should be seen, and what an end of a part is worth in characters.
LINE, PAUSE_US, LONGEST_US, LINGER_US, SHORTEST_US, PART_END = 32, 500_000, 6_000_000, 150_000, 800_000, 6
ENDS, HALF_ENDS = ".?!", ",;:"
#: What breaks cost: each caption, room left unused, an end within a sentence or after a part of one, a caption that is
#: seen for less than SHORTEST_US, and a sentence that ends inside.
EACH, UNUSED, TORN, HALF, BRIEF, INSIDE = 1.0, 1.0, 1.0, 0.25, 1.5, 0.5

#: What a caption of so many characters costs for itself and its unused room.
_ROOM = [EACH + UNUSED * max(0.0, 1 - n / (2 * LINE)) ** 2 for n in range(2 * LINE + 1)]


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), in which the value is worked out once however often it is named."""
    return F.transform(F.array(value), then)[0]


def two_lines(words: Column, line: int = LINE) -> Column:
    """The words as one line, or as the two that differ least in length (an end of a part before the break is worth
    PART_END), the earlier break of equals; null where there is no room. Functions of Spark only."""
    bonus = lambda a: F.when(F.right(a, F.lit(1)).isin(*ENDS, *HALF_ENDS), PART_END).otherwise(0)

    def broken(ws: Column, whole: Column) -> Column:
        size, left = F.char_length(whole), lambda b: F.char_length(b["a"])
        lefts = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ws) - 1)), lambda k: F.struct(F.array_join(F.slice(ws, F.lit(1), k), " ").alias("a"), k.alias("k")))
        breaks = F.filter(lefts, lambda b: (b["k"] < F.size(ws)) & (left(b) <= line) & (size - left(b) - 1 <= line))
        scored = F.transform(breaks, lambda b: F.struct((F.abs(2 * left(b) + 1 - size) - bonus(b["a"])).alias("score"), b["k"].alias("k"), b["a"].alias("a")))
        rest = lambda b: F.array_join(F.slice(ws, b["k"] + 1, F.size(ws)), " ")
        return _once(F.array_min(scored), lambda b: F.when(b.isNotNull(), F.concat(b["a"], F.lit("\n"), rest(b))))

    return _once(F.array_compact(words), lambda ws: _once(F.array_join(ws, " "), lambda whole: F.when(F.char_length(whole) <= line, whole).otherwise(broken(ws, whole))))


def roomy(lengths: list[int], line: int = LINE) -> bool:
    """Words of these lengths fit in two lines."""
    left, rows = line, 1
    for n in lengths:
        if n > left and left < line:
            left, rows = line, rows + 1
        if n > left or rows > 2:
            return False
        left -= n + 1
    return True


def cost_of(words: list[tuple[int, int, str]], last: bool) -> float:
    """What a caption of these words (start, end, text) costs; infinite if it has no room, a pause inside or lasts too
    long. A single word is always allowed."""
    lengths = [len(w) for *_, w in words]
    if len(words) > 1:
        apart = any(b[0] - a[1] >= PAUSE_US for a, b in zip(words, words[1:]))
        if apart or words[-1][1] - words[0][0] > LONGEST_US or not roomy(lengths):
            return float("inf")
    sign = words[-1][2][-1:]
    torn = 0.0 if last or sign in ENDS else HALF if sign in HALF_ENDS else TORN
    room = 1 - (sum(lengths) + len(words) - 1) / (2 * LINE)
    inside = sum(w[-1:] in ENDS for *_, w in words[:-1])
    return EACH + UNUSED * max(0.0, room) ** 2 + torn + BRIEF * (words[-1][1] - words[0][0] < SHORTEST_US) + INSIDE * inside


def segmentation(words: list[tuple[int, int, str]]) -> list[int]:
    """Ends of the captions (words before each break) of least total cost; of equals the one with the later last breaks.
    The best way to break the words before each place is found once, from the places before it that are in reach. Costs
    are cost_of's, from sums over the words before each place, so that each takes the same time however long a caption is."""
    count, starts, stops = len(words), [w[0] for w in words], [w[1] for w in words]
    sums, ended, torn = [0], [0], []
    for *_, w in words:
        sums.append(sums[-1] + len(w) + 1)
        ended.append(ended[-1] + (w[-1:] in ENDS))
        torn.append(0.0 if w[-1:] in ENDS else HALF if w[-1:] in HALF_ENDS else TORN)
    if count:
        torn[-1] = 0.0
    full, m = [], 0  # where a line ends that begins at each place
    for i in range(count):
        m = max(m, i)
        while m < count and sums[m + 1] - sums[i] <= LINE + 1:
            m += 1
        full.append(m)
    full.append(count)
    best, back, low = [0.0], [0], 0
    for j in range(1, count + 1):
        last, stop, chars, inside, own = j - 1, stops[j - 1], sums[j] - 1, ended[j - 1], torn[j - 1]
        if last and starts[last] - stops[last - 1] >= PAUSE_US:
            low = last
        while low < last and full[full[low]] < j:
            low += 1
        least, at = float("inf"), last
        for i in range(last, low - 1, -1):
            span = stop - starts[i]
            if span > LONGEST_US and i < last:
                break
            c = best[i] + (_ROOM[min(chars - sums[i], 2 * LINE)] + own + BRIEF * (span < SHORTEST_US) + INSIDE * (inside - ended[i]))
            if c < least - 1e-12:
                least, at = c, i
        best.append(least)
        back.append(at)
    out, j = [], count
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


def segmented(words: DataFrame, by: list[str], segment: str, end_us: str) -> DataFrame:
    """by, segment, n, start_us, end_us, text: captions of each segment of words (place, start_us, stop_us, word). A caption
    stays LINGER_US after its last word, or until it was seen for SHORTEST_US, but not into the next one, the next
    segment or beyond the group's end_us. The words of one segment meet in one row; segments are independent."""
    first = words.groupBy(*by, segment).agg(F.min("start_us").alias("_first"), F.max(end_us).alias("_end"), F.array_sort(F.collect_list(F.struct("start_us", "place", "stop_us", "word"))).alias("_words"))
    rows = first.select(*by, segment, F.least(F.coalesce(F.lead("_first").over(Window.partitionBy(*by).orderBy("_first", segment)), "_end"), "_end").alias("_limit"), "_words")
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by, segment).schema)

    def broken(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            row, n, low, high, own = [], [], [], [], []
            held = b.column("_words")
            fields = [held.flatten().field(f).to_pylist() for f in ("start_us", "stop_us", "word")]
            offsets = (held.offsets.to_numpy() - held.offsets[0].as_py()).tolist()
            for r, ((x, y), limit) in enumerate(zip(itertools.pairwise(offsets), b.column("_limit").to_pylist(), strict=True)):
                timed = list(zip(*(f[x:y] for f in fields), strict=True))
                ends = segmentation(timed)
                for k, (i, j) in enumerate(zip([0, *ends], ends, strict=False)):
                    nxt = timed[j][0] if j < len(timed) else limit
                    row.append(r)
                    n.append(k)
                    low.append(timed[i][0])
                    high.append(min(nxt, max(timed[j - 1][1] + LINGER_US, timed[i][0] + SHORTEST_US)))
                    own.append([w for *_, w in timed[i:j]])
            own_keys = [b.column(c).take(pa.array(row, pa.int64())) for c in (*by, segment)]
            yield pa.RecordBatch.from_arrays([*own_keys, pa.array(n, pa.int32()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(own, pa.list_(pa.string()))], names=[*by, segment, "n", "start_us", "end_us", "words"])

    got = rows.mapInArrow(broken, f"{keys}, n int, start_us long, end_us long, words array<string>")
    return got.select(*by, segment, "n", "start_us", "end_us", F.coalesce(two_lines(F.col("words")), F.array_join("words", " ")).alias("text"))


@query("s16_caption_segmentation")
def s16(spark: SparkSession, d: str) -> DataFrame:
    """Turns as segments of words that last 60 ms for each character."""
    words = turns(spark, d).select("conv_id", "pos", F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("place", "word"))
    size = F.char_length("word").cast("long") * 60_000
    before = F.coalesce(F.sum(size).over(Window.partitionBy("conv_id").orderBy("pos", "place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    timed = words.withColumn("start_us", before).withColumn("stop_us", before + size)
    return segmented(timed.withColumn("end", F.max("stop_us").over(Window.partitionBy("conv_id"))), ["conv_id"], "pos", "end")


_LINES = """w AS (SELECT item_id, string_split(text, ' ') AS ws, length(text) AS n FROM benchmark WHERE text IS NOT NULL),
k AS (SELECT item_id, unnest(range(1, len(ws))) AS k, ws FROM w),
s AS (SELECT item_id, k, array_to_string(ws[1:k], ' ') AS a, array_to_string(ws[k + 1:], ' ') AS b FROM k),
f AS (SELECT item_id, a, b, k, abs(length(a) - length(b)) - CASE WHEN right(a, 1) IN ('.', '?', '!', ',', ';', ':') THEN 6 ELSE 0 END AS score FROM s WHERE length(a) <= 160 AND length(b) <= 160)"""


@query("s17_two_lines", "SELECT w.item_id, CASE WHEN n <= 160 THEN array_to_string(ws, ' ') ELSE g.text END AS text FROM w LEFT JOIN (SELECT item_id, min_by(a || chr(10) || b, (score, k)) AS text FROM f GROUP BY 1) g ON w.item_id = g.item_id", (_LINES,))
def s17(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items in at most two lines of 160 characters; null where there is no room."""
    items = table(spark, d, "benchmark").where("text IS NOT NULL")
    return items.select("item_id", two_lines(F.split("text", " "), 160).alias("text"))
