"""Conversation structure repair by a fold in Spark SQL.

Windows find each turn's first fault: blank, duplicate (role and text seen earlier in the conversation) or truncated (the
last character is no end of a sentence). The turns of a conversation are then collected in order and folded by aggregate(),
which carries four (cost, audit) structs, one for each state of the pattern ``(s?(ua)+)?`` of role initials: nothing yet,
after s, after u, after a. Each turn adds Keep, Rerole and Delete, and after each turn a missing user or assistant may be
put in; the cheapest edits, and among equals the ASCII-least audit, come out of native least() expressions. Audits of one
state and as many turns never are prefixes of one another at equal cost, so that the least so far stays the least.

A conversation of over ROWS turns or BYTES is not collected. Its turns are sorted by ranges, numbered, and folded in
blocks of BLOCK turns from each of the four states; the blocks' tables are joined in pairs of states, FAN at a time, in a few
levels. Its duplicates are found by an aggregation (salted where one text is frequent), and its repaired text is
hashed block by block. Only the audit itself is one value.

Order: by turn, nulls first; ties by role and text. Defined cases: a null role or text reads as one blank, as does a null id
or turn in the damage's key; a null conversation id is a conversation of its own; roles count by their first character, an
empty or other role can't be kept; a conversation without rows has zero counts, an empty audit and the hash of an empty
text; gaps beyond a long are null; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, gathered, hot_join

#: Costs of the edits, and of a truncated turn that stays.
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
#: More than any real cost.
_FAR = 1 << 40
#: Turns and bytes up to which a conversation is one array; turns of a block and blocks joined at once for longer ones.
ROWS, BYTES = 1000, 32 << 20
BLOCK, FAN = 256, 32
#: Longer conversations are looked up in a broadcast table of at most so many; beyond that the limits rise.
MOST_LONG = 50_000
#: The bytes that count as white space, ends of sentences, pairs of initials that may meet.
BLANKS, ENDS, LEGAL = " \t\n\x0b\x0c\r", (".", "!", "?"), ("su", "ua", "au")
STATES = ("c0", "c1", "c2", "c3")
_COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _let(value: Column, then) -> Column:
    """``then`` of a value that is evaluated once; inside a lambda, an expression would be evaluated for each use."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def damage(frame: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, live): the rows after the damage that crc32 of ``conversation:turn`` asks for.

    A dropped row stays with live = false and nothing else, so that its conversation is known.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), blank))
    role, text = (F.coalesce(F.col(c).cast("string"), blank) for c in (role_col, text_col))
    rows = frame.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).cast("int").alias("kind"))
    copies = F.when(F.col("kind") == 0, F.array(F.lit(False))).when(F.col("kind") == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.lit(True)))
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text"))
    rows = rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.explode(copies).alias("live"))
    return rows.select("conv", *(F.when(F.col("live"), F.col(c)).alias(c) for c in ("turn", "role", "text")), "live")


def _told(rows: DataFrame) -> DataFrame:
    """``rows``, with ``seen``, and what may be done with each turn: its initial and the costs of its edits."""
    rest = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = rows.withColumn("blank", rest == "").withColumn("last", F.substring(rest, -1, 1))
    rows = rows.withColumn("duplicate", ~F.col("blank") & F.col("seen"))
    rows = rows.withColumn("must", F.col("blank") | F.col("duplicate"))
    rows = rows.withColumn("truncated", ~F.col("must") & ~F.col("last").isin(*ENDS)).withColumn("initial", F.substring("role", 1, 1))
    pay = F.when(F.col("truncated"), TRUNCATED).otherwise(0)
    cost = lambda role, other: F.when(F.col("must"), _FAR).when(F.col("initial") == role, pay).otherwise(other).cast("long")
    edit = lambda role: F.when(F.col("initial") == role, "K").otherwise("R")
    return rows.drop("last").withColumns({"s_pay": cost("s", F.lit(_FAR)), "u_pay": cost("u", pay + REROLE), "a_pay": cost("a", pay + REROLE), "u_edit": edit("u"), "a_edit": edit("a")})


def _turns() -> Column:
    return F.struct("turn", "role", "text", "initial", "s_pay", "u_pay", "a_pay", "u_edit", "a_edit")


def _state(cost, audit: str) -> Column:
    return F.struct(F.lit(cost).cast("long").alias("cost"), F.lit(audit).alias("audit"))


def _add(state: Column, cost, letters) -> Column:
    more = cost if isinstance(cost, Column) else F.lit(cost).cast("long")
    return F.struct((state["cost"] + more).alias("cost"), F.concat(state["audit"], letters if isinstance(letters, Column) else F.lit(letters)).alias("audit"))


def _states(*states: Column) -> Column:
    return F.struct(*(s.alias(n) for s, n in zip(states, STATES, strict=True)))


def _closed(states: Column) -> Column:
    """The states after turns were put in, where that is cheaper."""

    def put(c: Column) -> Column:
        u = F.least(c["c2"], _add(F.least(c["c0"], c["c1"], c["c3"]), INSERT, "I"))
        return _let(u, lambda u: _states(c["c0"], c["c1"], u, F.least(c["c3"], _add(u, INSERT, "I"))))

    return _let(states, put)


def _step(c: Column, x: Column) -> Column:
    gone = lambda n: _add(c[n], DELETE, "D")
    s = F.least(gone("c1"), _add(c["c0"], x["s_pay"], "K"))
    u = F.least(gone("c2"), _add(F.least(c["c0"], c["c1"], c["c3"]), x["u_pay"], x["u_edit"]))
    a = F.least(gone("c3"), _add(c["c2"], x["a_pay"], x["a_edit"]))
    return _closed(_states(gone("c0"), s, u, a))


def _beginning() -> Column:
    return _states(_state(0, ""), _state(_FAR, ""), _state(INSERT, "I"), _state(2 * INSERT, "II"))


def _expected(at: Column, has_s: Column) -> Column:
    """The role at a place of the repaired conversation that no kept system turn has."""
    return F.when((at - has_s) % 2 == 0, "user").otherwise("assistant")


def _pieces(audit: Column) -> Column:
    """The edits of each turn: what is put in before it, and its own; the last item is what is put in at the end."""
    return F.concat(F.regexp_extract_all(audit, F.lit("I*[DKR]"), F.lit(0)), F.array(F.regexp_extract(audit, "I*$", 0)))


def _kept(edits: Column) -> Column:
    return F.length(F.translate(edits, "D", ""))


def _lines(turns: Column, pieces: Column, before: Column, has_s: Column) -> Column:
    """The repaired lines; ``before`` is the number of lines ahead of these, and an item of ``pieces`` without a turn is put in at the end."""

    def of(piece: Column, i: Column) -> Column:
        x = F.get(turns, i)
        at = before + _kept(F.array_join(F.slice(pieces, 1, i), ""))
        puts = F.length(F.regexp_extract(piece, "^I*", 0))

        def made(at: Column) -> Column:
            new = F.transform(F.when(puts > 0, F.sequence(F.lit(0), puts - 1)).otherwise(F.array().cast("array<int>")), lambda j: F.concat(_expected(at + j, has_s), F.lit(":")))
            last = F.right(piece, F.lit(1))
            own = F.when(last == "K", F.array(F.concat(x["role"], F.lit(":"), x["text"]))).when(last == "R", F.array(F.concat(_expected(at + puts, has_s), F.lit(":"), x["text"])))
            return F.concat(new, F.coalesce(own, F.array().cast("array<string>")))

        return _let(at, made)

    return F.flatten(F.transform(pieces, of))


def _starts_with_s(turns: Column, pieces: Column) -> Column:
    """1 if the first turn that is not deleted is a system turn that is kept, 0 if it is another, null if there is none."""
    told = F.filter(F.transform(pieces, lambda p, i: F.struct(p.alias("p"), F.get(turns, i)["initial"].alias("r"))), lambda x: (x["p"] != "D") & (x["p"] != ""))
    return _let(F.get(told, F.lit(0)), lambda x: F.when(x.isNotNull(), ((x["p"] == "K") & (x["r"] == "s")).cast("int")))


def _gaps(low: Column, high: Column, different: Column) -> Column:
    return F.when(low.isNull(), F.lit(0).cast("long")).otherwise(F.try_subtract(F.try_add(F.try_subtract(high, low), F.lit(1).cast("long")), different))


def _count(flag: Column) -> Column:
    return F.coalesce(F.sum(flag.cast("long")), F.lit(0).cast("long"))


def _by_arrays(rows: DataFrame) -> DataFrame:
    """Repair of conversations of bounded size: one shuffle by conversation."""
    same = Window.partitionBy("conv", "live", "role", "h", "text").orderBy(F.col("turn").asc_nulls_first())
    line = Window.partitionBy("conv").orderBy(F.col("live").desc(), F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.repartition("conv").withColumn("h", F.xxhash64("text")).withColumn("seen", F.row_number().over(same) > 1).drop("h")
    rows = _told(rows)
    rows = rows.withColumns({"ahead": F.lag("initial").over(line), "turn_ahead": F.lag("turn").over(line)})
    new_turn = F.col("turn").isNotNull() & (F.col("turn_ahead").isNull() | (F.col("turn_ahead") != F.col("turn")))
    illegal = F.col("live") & F.col("ahead").isNotNull() & ~F.concat("ahead", "initial").isin(*LEGAL)
    own = rows.groupBy("conv").agg(
        _gaps(F.min("turn"), F.max("turn"), _count(new_turn)).alias("gaps"),
        *(_count(F.col("live") & F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated")),
        _count(illegal).alias("illegal"),
        F.sort_array(F.collect_list(F.when(F.col("live"), _turns()))).alias("turns"),
    )
    best = F.aggregate("turns", _beginning(), _step, lambda c: F.least(c["c0"], c["c3"]))
    own = own.withColumn("best", best).withColumn("pieces", _pieces(F.col("best.audit")))
    has_s = F.coalesce(_starts_with_s(F.col("turns"), F.col("pieces")), F.lit(0))
    text = _let(has_s, lambda s: F.array_join(_lines(F.col("turns"), F.col("pieces"), F.lit(0), s), "\n"))
    return own.select("conv", *_COLUMNS[:5], F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), F.sha2(text, 256).alias("repaired_sha256"))


def _joined(a: Column, b: Column) -> Column:
    """The table (from state, to state) of two runs of turns, one after the other."""

    def through(frm: Column, to: str) -> Column:
        ways = [_add(frm[k], F.get(b, F.lit(i))[to]["cost"], F.get(b, F.lit(i))[to]["audit"]) for i, k in enumerate(STATES)]
        return _let(F.least(*ways), lambda s: F.when(s["cost"] < _FAR, s).otherwise(_state(_FAR, "")))

    return F.transform(a, lambda frm: _states(*(through(frm, to) for to in STATES)))


def _run(turns: Column) -> Column:
    """What a block adds: its borders, its counts inside, and its table."""
    start = [_states(*(_state(0 if i == j else _FAR, "") for j in range(4))) for i in range(4)]
    table = F.aggregate(turns, F.array(*start), lambda c, x: F.transform(c, lambda own: _step(own, x)))
    ends = lambda f: F.struct(F.get(turns, F.lit(0))[f].alias("first"), F.element_at(turns, -1)[f].alias("last"))
    return F.struct(ends("initial").alias("initial"), ends("turn").alias("turn"), F.col("illegal"), F.col("turns_n"), table.alias("table"))


def _follow(a: Column, b: Column) -> Column:
    """The run of two runs."""
    bad = (~F.concat(a["initial"]["last"], b["initial"]["first"]).isin(*LEGAL)).cast("long")
    same = F.coalesce(a["turn"]["last"] == b["turn"]["first"], F.lit(False)).cast("long")
    ends = lambda f: F.struct(a[f]["first"].alias("first"), b[f]["last"].alias("last"))
    return F.struct(ends("initial").alias("initial"), ends("turn").alias("turn"), (a["illegal"] + b["illegal"] + bad).alias("illegal"), (a["turns_n"] + b["turns_n"] - same).alias("turns_n"), _joined(a["table"], b["table"]).alias("table"))


def _in_order(key: str, value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v")))), lambda y: y["v"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ck, part) sorted by conversation and place -> (ck, sha): each conversation's parts, newline-joined, hashed as they pass."""
    key, own = None, None
    for batch in batches:
        for ck, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ck != key:
                if own:
                    yield pa.RecordBatch.from_pydict({"ck": [key], "sha": [own.hexdigest()]})
                key, own, any_part = ck, hashlib.sha256(), False
            if part is not None:
                own.update((b"\n" if any_part else b"") + part.encode())
                any_part = True
    if own:
        yield pa.RecordBatch.from_pydict({"ck": [key], "sha": [own.hexdigest()]})


def _by_blocks(rows: DataFrame) -> DataFrame:
    """Repair of conversations of any length: the same results as ``_by_arrays`` gives."""
    ck = F.when(F.col("conv").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv").cast("string")))
    order = [F.col("ck"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    live = rows.filter("live").withColumn("ck", ck)
    live = live.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    live = checkpoint(live.select("conv", "ck", "turn", "role", "text", "at").withColumns({"h": F.xxhash64("text"), "g": F.xxhash64(F.lit(1), "text")}))
    first = live.groupBy("ck", "role", "h", "g").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    told = _told(hot_join(live, first.drop("n"), ["ck", "role", "h", "g"], ["at"], counts=first).withColumn("seen", F.col("at") > F.col("first")))
    counts = told.groupBy("ck").agg(F.first("conv").alias("conv"), F.min("turn").alias("low"), F.max("turn").alias("high"), *(_count(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated")))

    blocks = checkpoint(told.withColumn("block", F.floor(F.col("at") / BLOCK)).groupBy("ck", "block").agg(_in_order("at", _turns()).alias("turns")))
    ahead = lambda i: F.get(F.col("turns"), i - 1)
    over = F.transform("turns", lambda x, i: F.struct(x["initial"].alias("initial"), x["turn"].alias("turn"), ahead(i)["initial"].alias("was"), ahead(i)["turn"].alias("turn_was"), i.alias("i")))
    bad = F.size(F.filter(over, lambda x: (x["i"] > 0) & ~F.concat(x["was"], x["initial"]).isin(*LEGAL)))
    new = F.size(F.filter(over, lambda x: x["turn"].isNotNull() & (x["turn_was"].isNull() | (x["turn_was"] != x["turn"]))))
    # The blocks of a conversation are numbered without their turns.
    place = Window.partitionBy("ck").orderBy("block")
    numbered = blocks.select("ck", "block", F.size("turns").alias("n"))
    numbered = gathered(numbered.withColumns({"no": F.row_number().over(place) - 1, "start": (F.sum("n").over(place) - F.col("n")).cast("int")}))
    runs = blocks.withColumns({"illegal": bad.cast("long"), "turns_n": new.cast("long")}).select("ck", "block", _run(F.col("turns")).alias("run"))
    runs = gathered(runs.join(numbered.select("ck", "block", "no"), ["ck", "block"]).select("ck", "no", "run"))
    left = (numbered.agg(F.max("no")).first()[0] or 0) + 1
    while left > 1:
        groups = runs.groupBy("ck", F.floor(F.col("no") / FAN).alias("no")).agg(_in_order("no", F.col("run")).alias("all"))
        first_run = F.get(F.col("all"), F.lit(0))
        rest = F.slice("all", 2, FAN)
        runs = gathered(groups.select("ck", "no", F.aggregate(rest, first_run, _follow).alias("run")))
        left = -(-left // FAN)
    whole = runs.select("ck", "run.illegal", "run.turns_n", _joined(F.array(_beginning()), F.col("run.table")).alias("t"))
    whole = whole.withColumn("t", F.get("t", F.lit(0))).withColumn("best", F.least("t.c0", "t.c3"))
    whole = gathered(whole.select("ck", "illegal", "turns_n", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit")))

    # Each block's share of the audit; the last one also has what is put in at the end.
    sizes = numbered.groupBy("ck").agg(F.collect_list(F.struct("no", "block", "n", "start")).alias("blocks"))
    dealt = whole.select("ck", _pieces(F.col("audit")).alias("pieces")).join(sizes, "ck")

    def share(b: Column) -> Column:
        last = b["start"] + b["n"] == F.size("pieces") - 1
        return F.struct(b["block"].alias("block"), b["no"].alias("no"), F.slice("pieces", b["start"] + 1, b["n"] + last.cast("int")).alias("pieces"))

    dealt = dealt.select("ck", F.explode(F.transform("blocks", share)).alias("b")).select("ck", "b.*")
    met = blocks.join(gathered(dealt), ["ck", "block"])
    kept = gathered(met.select("ck", "no", _kept(F.array_join("pieces", "")).alias("kept"), _starts_with_s(F.col("turns"), F.col("pieces")).alias("s")))
    sums = Window.partitionBy("ck").orderBy("no")
    kept = kept.select("ck", "no", (F.sum("kept").over(sums) - F.col("kept")).alias("before"), F.coalesce(F.first("s", ignorenulls=True).over(sums.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0)).alias("s"))
    lines = met.join(gathered(kept), ["ck", "no"]).select("ck", "no", _lines(F.col("turns"), F.col("pieces"), F.col("before"), F.col("s")).alias("lines"))
    parts = lines.select("ck", "no", F.when(F.size("lines") > 0, F.array_join("lines", "\n")).alias("part"))
    hashed = parts.repartition("ck").sortWithinPartitions("ck", "no").select("ck", "part").mapInArrow(_hashes, "ck string, sha string")
    out = counts.join(whole, "ck").join(hashed, "ck")
    return out.select("conv", _gaps(F.col("low"), F.col("high"), F.col("turns_n")).alias("gaps"), *_COLUMNS[1:], F.col("sha").alias("repaired_sha256"))


def repair(rows: DataFrame, max_rows: int = ROWS, max_bytes: int = BYTES) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of rows (conv, turn, role, text, live)."""
    sizes = rows.groupBy("conv").agg(F.count_if("live").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))
    total = sizes.agg(F.sum("n"), F.sum("bytes"), F.max("n"), F.max("bytes")).first()
    if total[2] is None or (total[2] <= max_rows and total[3] <= max_bytes):
        return _by_arrays(rows)
    max_rows, max_bytes = max(max_rows, 2 * total[0] // MOST_LONG), max(max_bytes, 2 * total[1] // MOST_LONG)
    long = gathered(sizes.filter((F.col("n") > max_rows) | (F.col("bytes") > max_bytes)).select(F.col("conv").alias("long_conv"), F.lit(True).alias("long")))
    marked = rows.join(F.broadcast(long), F.col("conv").eqNullSafe(F.col("long_conv")), "left").drop("long_conv")
    return _by_arrays(marked.filter("long is null").drop("long")).unionByName(_by_blocks(marked.filter("long").drop("long")))


def damaged_and_repaired(frame: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", max_rows: int = ROWS, max_bytes: int = BYTES) -> DataFrame:
    """One row for each conversation of ``frame``: its faults after the damage, and its cheapest repair."""
    rows = damage(frame, conv_col, turn_col, role_col, text_col)
    return repair(rows, max_rows, max_bytes).withColumnRenamed("conv", conv_col)
