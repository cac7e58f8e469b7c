"""Problem 4: raw transcript lines into clean, ordered speaker turns.

Layouts are mined, not assumed. The head of a line is cut into at most three *units*: bracketed groups, tokens of digits
and marks, and words that a delimiter follows (glued to them or after a blank). With digits masked in what looks like a
time, heads form a token tree of fixed depth: a level a unit, a node for every unit that at least ``support`` lines have
under the same parent, a wildcard for the rest. Heads are counted once over all lines; the tree is made of that table of
counts by group-bys and joins, a level at a time, and nothing of it reaches the driver. Slots are inferred for each unit
in its layout (the path to it), and over all layouts together where its layout has too few lines to judge by:

* a *timestamp* slot is a shape whose values agree with the lines' own start times;
* a *speaker* slot is a unit whose lines of known side are on one side, more so than chance allows.

A mark that agrees with the start of its own line is a timestamp however rare its shape, and where too few lines show the
side of a label, the word in it may name a side; no list says how either is laid out. A head ends at the first unit that
is neither a slot nor a bracketed group. Cleaning is by regular expressions in the JVM. Turns are runs of equal sides in
order of start.

Nulls: a line without text, or with no spoken word left, is in no turn; neither is one without usable times. A null or
unknown speaker falls back on the label, else the side is ``unknown``. Rows that repeat an id count once (the earliest
loaded); rows without an id count once for each distinct row. Ties in start are ordered by end, then id. An empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.operators.intervals import usable
from callweave.operators.ordered import previous_in_order, run_numbers
from callweave.session import durable

# fixed values: spellings of the two sides in the speaker column
DISPATCHER_VALUES = ["0", "0.0", "dispatcher", "상담원", "119대원", "spk0"]
REPORTER_VALUES = ["1", "1.0", "reporter", "caller", "신고자", "spk1"]
# fixed values: words that name a side
DISPATCHER_WORDS = ["상담원", "접수요원", "접수자", "119대원", "119", "dispatcher", "operator", "spk0"]
REPORTER_WORDS = ["신고자", "신고인", "민원인", "caller", "reporter", "spk1"]
# fixed values: hesitation sounds, marks between their letters taken out
HESITATION = r"으*음+|어+|아아+|에+|흠+|u+m+|u+h+|h+m+|e+r+m*"

DEPTH = 3
_OPEN, _CLOSE = r"\[(<{【", r"\])>}】"
_GROUP = rf"\(\([^()]*\)\)|[{_OPEN}][^{_OPEN}{_CLOSE}]*[{_CLOSE}]"  # openers inside would make long runs of them quadratic
_SOUND = rf"{_GROUP}|\*[^*]*\*|[♪♫♬]"
# what may part a label from what is said: any mark but those that end or stretch a word, quote, or open a group
_DELIMITER = rf"[^\p{{L}}\p{{N}}\s.,!?…~'\"‘’“”。、♪♫♬*\-–—{_OPEN}]"
_MARK = rf"[^\p{{L}}\p{{N}}\s{_OPEN}]{{0,2}}\p{{N}}[\p{{N}}:.]{{0,14}}(?:ms|s|초)?[^\p{{L}}\p{{N}}\s{_OPEN}]{{0,2}}(?=\s|$)"
_LABEL = rf"[\p{{L}}\p{{N}}_]{{1,20}}(?:{_DELIMITER}{{1,2}}|\s{{1,3}}(?:[-–—]|{_DELIMITER}){{1,2}}(?=\s|$))"
_SHORT_GROUP = rf"\(\([^()]{{1,40}}\)\)|[{_OPEN}][^{_OPEN}{_CLOSE}]{{1,40}}[{_CLOSE}]"
_UNIT = rf"(?:{_SHORT_GROUP}|{_MARK}|{_LABEL})\s*"
_TIME = r"^\W*\d+(?:[:.]\d+)*(?:ms|s|초)?\W*$"


def _width(col: Column) -> Column:
    """Full-width ASCII as ASCII."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　 "
    narrow = F.translate(col, wide, "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + "  ")
    return F.when(col.rlike("[\uff01-\uff5e\u3000\u00a0]"), narrow).otherwise(col)


def side_of(speaker: str) -> Column:
    v = F.lower(F.regexp_replace(_width(F.col(speaker)), r"(?U)\s+", ""))
    return F.when(v.isin(DISPATCHER_VALUES), "dispatcher").when(v.isin(REPORTER_VALUES), "reporter")


def _named(unit: Column) -> Column:
    """The side that the word in a unit names."""
    w = F.regexp_replace(unit, r"[^\p{L}\p{N}]", "")
    return F.when(w.isin(DISPATCHER_WORDS), "dispatcher").when(w.isin(REPORTER_WORDS), "reporter")


def _seconds(unit: Column) -> Column:
    """The value of a time mark: groups of digits, base 60 where colons part them; of ``ms`` a thousandth."""
    parts = F.transform(F.split(F.regexp_replace(unit, r"[^\d:.]", ""), ":"), lambda p: F.coalesce(p.try_cast("double"), F.lit(-1e9)))
    return F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p) / F.when(unit.contains("ms"), 1000.0).otherwise(1.0)


def with_units(lines: DataFrame, within_ms: int = 1500) -> DataFrame:
    """``lines`` with ``_units`` (the raw units of the head, blanks after them included), ``_keys`` (the units folded,
    digits masked in times) and ``_agrees`` (whether each is a time that agrees with ``startAt``); null without a head."""
    head = F.regexp_extract("_text", rf"^\s*(?:{_UNIT}){{1,{DEPTH}}}", 0)
    d = lines.withColumn("_head", F.when(head != "", head))
    d = d.withColumn("_units", F.when(F.col("_head").isNotNull(), F.regexp_extract_all("_head", F.lit(rf"\s*{_UNIT}"), F.lit(0))))
    fold = lambda u: F.lower(F.regexp_replace(u, r"\s+", ""))
    time = lambda u: u.rlike(_TIME) & u.rlike(r"\D")
    key = lambda u: F.when(time(u) & u.rlike(r"\d[:.]\d|\d(?:ms|s|초)|\d{4}"), F.regexp_replace(u, r"\d+", "0")).otherwise(u)
    near = F.col("startAt")
    return d.withColumns(
        {
            "_keys": F.transform("_units", lambda u: key(fold(u))),
            "_agrees": F.transform("_units", lambda u: time(fold(u)) & (F.abs(_seconds(fold(u)) * 1000 - near) <= within_ms)),
        }
    )


def _kind(n: Column, known: Column, reporter: Column, agrees: Column, base: float, agree: float, pure: float, evidence: float) -> Column:
    """What lines show about a unit: ``time``, a side, ``text``, or null where they are too few to tell. ``evidence``: the
    log-likelihood ratio, against the share ``base`` of the reporter in all, that a side has to reach."""
    share = reporter / known
    ratio = lambda p, b: F.when(p > 0, p * F.log(p / b)).otherwise(0.0)
    sure = known * (ratio(share, F.lit(base)) + ratio(1 - share, F.lit(1 - base))) >= evidence
    return (
        F.when((n >= 8) & (agrees >= agree * n), "time")
        .when((known > 0) & (share >= pure) & sure, "reporter")
        .when((known > 0) & (share <= 1 - pure) & sure, "dispatcher")
        .when((known >= 15) & (share < pure) & (share > 1 - pure), "text")
    )


def mine_layouts(lines: DataFrame, support: int = 20, agree: float = 0.8, pure: float = 0.95, evidence: float = 10.0) -> DataFrame:
    """The token tree: one row for each distinct head (``_keys``) with the kind of each unit (``kinds``: time, dispatcher,
    reporter or text) and its layout (``layout``: the path with wildcards). ``lines``: see :func:`with_units`, with the
    known sides in ``_side``. A stored table; heads without any slot are left out."""
    heads = durable(
        lines.where(F.col("_keys").isNotNull())
        .groupBy("_keys")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("_side").alias("known"),
            F.count(F.when(F.col("_side") == "reporter", 1)).alias("rep"),
            *[F.count(F.when(F.get("_agrees", F.lit(i)), 1)).alias(f"ok{i}") for i in range(DEPTH)],
        ),
        "heads",
    )
    known, rep = heads.agg(F.sum("known"), F.sum("rep")).first()
    base = min(max((rep or 0) / max(known or 0, 1), 0.05), 0.95)
    sums = [F.sum(c).alias(c) for c in ("n", "known", "rep", "ok")]
    kind = lambda: _kind(F.col("n"), F.col("known"), F.col("rep"), F.col("ok"), base, agree, pure, evidence)
    levels = [heads.select(F.get("_keys", F.lit(i)).alias("key"), "n", "known", "rep", F.col(f"ok{i}").alias("ok")).where("key is not null") for i in range(DEPTH)]
    anywhere = levels[0].unionByName(levels[1]).unionByName(levels[2]).groupBy("key").agg(*sums).select("key", kind().alias("any"))
    tree = heads.withColumn("_path", F.lit(""))
    for i in range(DEPTH):
        here = tree.withColumn("key", F.get("_keys", F.lit(i)))
        node = here.where("key is not null").withColumn("ok", F.col(f"ok{i}")).groupBy(F.col("_path").alias("path"), "key").agg(*sums)
        node = node.select("path", F.col("key").alias("unit"), (F.col("n") >= support).alias("node"), kind().alias("own")).join(anywhere, F.col("unit") == F.col("key"), "left").drop("key")
        judged = F.coalesce(F.when(F.col("node"), F.col("own")), F.col("any"), _named(F.col("unit")), F.lit("text"))
        node = node.select("path", "unit", judged.alias(f"kind{i}"), F.concat("path", F.lit("\u0001"), F.when(F.col("node"), F.col("unit")).otherwise("*")).alias("next"))
        tree = here.join(node, (F.col("_path") == F.col("path")) & (F.col("key") == F.col("unit")), "left").withColumn("_path", F.coalesce("next", "_path")).drop("key", "path", "unit", "next")
    kinds = F.array_compact(F.array(*[f"kind{i}" for i in range(DEPTH)]))
    return durable(tree.select("_keys", kinds.alias("kinds"), F.col("_path").alias("layout")).where(F.exists("kinds", lambda k: k != "text")), "layouts")


def _slots(kinds: Column) -> Column:
    """How many units the head has up to its last slot."""
    reach = F.aggregate(
        F.sequence(F.lit(0), F.size("_units") - 1),
        F.struct(F.lit(0).alias("cut"), F.lit(True).alias("open")),
        lambda a, i: F.struct(
            F.when(a["open"] & (F.get(kinds, i) != "text"), i + 1).otherwise(a["cut"]).alias("cut"),
            (a["open"] & ((F.get(kinds, i) != "text") | F.get("_units", i).rlike(rf"^\s*[{_OPEN}]"))).alias("open"),
        ),
    )
    return reach["cut"]


def clean_lines(u: DataFrame, text: bool = True) -> DataFrame:
    """``call_id, id, startAt, endAt, role`` and, with ``text``, ``spoken`` of every usable line with a spoken word, each
    id once. Lines are cleaned where they are scanned, so without ``text`` none is shuffled: the table of layouts is read
    from storage, small enough to be broadcast in general and joined by shuffle where Spark finds it is not (lines without
    a head are spread then). Layouts are mined from the rows as they are scanned; repeated rows weigh twice there, which
    decides nothing."""
    raw = u.where(usable() & F.col("text").isNotNull()).select("call_id", "id", "startAt", "endAt", "loaded_at", "text", "speaker", _width(F.trim(F.col("text"))).alias("_text"), side_of("speaker").alias("_side"))
    lines = with_units(raw)
    layouts = mine_layouts(lines)
    spread = F.array(F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("id", "startAt"), F.lit(4096)).cast("string")))
    keyed = lines.withColumn("_at", F.coalesce("_keys", spread)).join(layouts.select(F.col("_keys").alias("_at"), "kinds"), "_at", "left")
    kinds = F.transform("_units", lambda _, i: F.coalesce(F.nullif(F.get("kinds", i), F.lit("text")), F.when(F.get("_agrees", i), "time"), F.lit("text")))
    placed = keyed.withColumn("_kinds", kinds).withColumn("_cut", F.when(F.col("_units").isNull(), 0).otherwise(_slots(F.col("_kinds"))))
    slots = F.slice("_kinds", 1, F.col("_cut"))
    label = F.get(F.filter(slots, lambda k: k.isin("dispatcher", "reporter")), F.lit(0))
    length = F.aggregate(F.slice("_units", 1, F.col("_cut")), F.lit(0), lambda a, x: a + F.length(x))
    body = F.when(F.col("_cut") > 0, F.substring(F.col("_text"), length + 1, F.length("_text"))).otherwise(F.col("_text"))
    rest = F.regexp_replace(body, _SOUND, " ")
    rest = F.when(rest.contains(":"), F.regexp_replace(rest, r"(?<![\d:])\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?(?![\d:])", " ")).otherwise(rest)
    bare = lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}\s]|[ㄱ-ㆎ]", ""))
    if text:
        words = F.filter(F.split(rest, r"(?U)\s+"), lambda w: (bare(w) != "") & ~bare(w).rlike(rf"^(?:{HESITATION})$"))
        spoken = F.array_join(words, " ")
    else:
        spoken = bare(rest).rlike(rf"(?U)(?<!\S)(?!(?:{HESITATION})(?!\S))\S")
    line = ["call_id", "startAt", "endAt", "role", "spoken"]
    twin = F.when(F.col("id").isNull(), F.xxhash64("call_id", "startAt", "endAt", "text", "speaker"))
    once = (
        placed.select("id", twin.alias("_twin"), "loaded_at", "call_id", "startAt", "endAt", F.coalesce("_side", label, F.lit("unknown")).alias("role"), spoken.alias("spoken"))
        .groupBy("id", "_twin")
        .agg(F.min(F.struct("loaded_at", *line)).alias("r"))
        .select("id", *[F.col("r")[c].alias(c) for c in line])
    )
    return once.where("spoken <> ''") if text else once.where("spoken").drop("spoken")


def turn_starts(u: DataFrame) -> DataFrame:
    """The first line of every turn: ``call_id, first_id, role``."""
    p = previous_in_order(clean_lines(u, text=False), ["call_id"], "startAt", ["role"], tie=["endAt", "id"])
    return p.where(F.col("prev_role").isNull() | (F.col("prev_role") != F.col("role"))).select("call_id", F.col("id").alias("first_id"), "role")


def turns(u: DataFrame) -> DataFrame:
    """Every turn with its ordinal, times, number of lines and spoken text. A turn is one row, so one turn has to fit
    into memory; calls need not."""
    ln = clean_lines(u)
    numbered = run_numbers(ln, ["call_id"], "startAt", "role", "turn_no", tie=["endAt", "id"])
    line = F.struct("startAt", "endAt", "id", "spoken")
    return numbered.groupBy("call_id", "turn_no", "role").agg(
        F.min_by("id", F.struct("startAt", "endAt", "id")).alias("first_id"),
        F.min("startAt").alias("turn_start"),
        F.max("endAt").alias("turn_end"),
        F.count(F.lit(1)).alias("n_lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["spoken"]), " ").alias("turn_text"),
    )
