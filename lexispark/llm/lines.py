"""Line dedup by a log-template tree, with DataFrame operations only.

A line's tokens with a digit are variable fields, unless more than half of its tokens have one: such lines (rows of
numbers, listings, hashes) are told apart by their content and kept unmasked. The tree has a fixed depth: the number of
tokens, then the first LEAD tokens. In a leaf the template seen in most documents generalises: templates of the leaf
that agree with it in at least ``similarity`` of the tokens after the first LEAD become the same template, the other
tokens being variable. Of the others the one seen in most documents generalises next, and so on until no two are alike;
a template that is like several of them belongs to the first. Templates that recur across documents are dropped: each
line of theirs goes from every document but the one with the smallest id, so that nothing is lost altogether.

The lines' texts are not shuffled: only hashes of leaf and template are. Tokens are fetched for the few templates that
share their leaf with others, once for each template, from the first document that holds it. The text itself moves when
a document meets the list of its dropped lines, and once more where the list of lines to fetch is too large to
broadcast. Counts are aggregated map-side, lines are never gathered by template, and keys that many rows share are
salted. Within a leaf 64-bit hashes stand for templates.

With ``copies``, a document is left whole if it is a near-copy (by the Jaccard similarity of its sets of five-word
shingles) of a document that keeps lines of it, so that a near-duplicate stage that follows sees it as it
is; only documents that share COPIED of their tokens in lines are compared.

Defined cases: a null or empty text and a row with a null id pass through unchanged; lines of fewer than
``min_tokens`` tokens (a parameter, 1 at least) are never dropped; lines that recur within one document only stay; rows
with equal id and text are one document; a document that loses all its lines keeps an empty text; ties between a leaf's
templates go to the one whose first line (id, position) is smallest; extra columns pass through whatever their names, and columns
named like the added ones are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from .common import fresh, gathered, hot_join, join_checked, sized_join, small

LEAD = 3
#: Words of the shingles by which near-copies are told, and the share of tokens that these share in lines at least.
SHINGLE, COPIED = 5, 0.2
#: Comparisons of tokens (templates squared, by tokens) up to which a leaf's templates are compared as one array.
WORK = 300_000_000
FIELD = "<*>"
#: White space within a line, all read as a blank.
_BLANKS = "\t\r\f\x0b"


def _let(value: Column, then) -> Column:
    """``then`` of a value that is evaluated once; inside a lambda, an expression would be evaluated for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _masked(text: Column) -> Column:
    """The lines' tokens with one blank between them, variable fields masked; texts that have neither need no regex.

    The look-behind keeps the pattern linear in long tokens.
    """
    spaced = F.when(text.rlike(f"[{_BLANKS}]|  "), F.regexp_replace(text, f"[ {_BLANKS}]+", " ")).otherwise(text)
    fields = F.regexp_replace(spaced, "(?<![^ \n])[^ 0-9\n]*+[0-9][^ \n]*+", FIELD)
    parts = lambda lines: F.transform(F.split(lines, "\n"), lambda line: F.trim(line))
    # Half of the tokens are constant at least, or the line stays as it is.
    told = F.zip_with(parts(fields), parts(spaced), lambda f, plain: F.when(2 * _n_fields(f) <= _n_tokens(f), f).otherwise(plain))
    return F.when(text.rlike("[0-9]"), told).otherwise(parts(spaced))


def _n_fields(masked: Column) -> Column:
    return (F.length(masked) - F.length(F.replace(masked, F.lit(FIELD), F.lit("")))) / len(FIELD)


def _n_tokens(masked: Column) -> Column:
    return F.when(masked == "", 0).otherwise(F.length(masked) - F.length(F.replace(masked, F.lit(" "), F.lit(""))) + 1)


def _coded(rows: DataFrame) -> DataFrame:
    """``rows`` with leaf and tmpl, the hashes of ``masked`` of ``n`` tokens."""
    rows = rows.withColumn("lead", F.substring_index("masked", " ", LEAD))
    return rows.withColumns({"leaf": F.xxhash64("n", "lead"), "tmpl": F.xxhash64("masked", F.lit(1))})


def template_lines(docs: DataFrame, id_col: str, text_col: str, min_tokens: int) -> DataFrame:
    """(doc, key, pos, n, leaf, tmpl) of each line that may be dropped; n is its tokens, key tells apart texts of one id."""
    rows = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("key"), F.posexplode(_masked(F.col(text_col))).alias("pos", "masked"))
    rows = rows.withColumn("n", _n_tokens(F.col("masked"))).filter(F.col("n") >= min_tokens)
    return _coded(rows).select("doc", "key", "pos", F.col("n").cast("int"), "leaf", "tmpl")


def template_tokens(docs: DataFrame, held: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``held`` (leaf, tmpl, first, pos, ...) with the hashes of the tokens after the first LEAD, read at its first line.

    Texts of one id are told apart by what stands at the position; where several hold the template, the row repeats.
    """
    wanted = held.groupBy(F.col("first").alias("doc")).agg(F.collect_set("pos").alias("wanted"))
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(wanted) if small(held, 32) else wanted, "doc")
    taken = lambda parts: F.transform("wanted", lambda i: F.get(parts, i))
    rows = rows.select(F.explode(_let(F.split("text", "\n"), taken)).alias("line"))
    rows = rows.select(F.get(_masked(F.col("line")), F.lit(0)).alias("masked"))
    rows = _coded(rows.withColumn("n", _n_tokens(F.col("masked"))))
    rest = F.split(F.expr("substring(masked, length(lead) + 2)"), " ")
    rows = rows.select("leaf", "tmpl", F.transform(rest, lambda t: F.xxhash64(t)).alias("tokens"))
    return join_checked(rows, held, ["leaf", "tmpl"], "inner", 64)


def _alike(a: Column | str, b: Column | str, similarity: float) -> Column:
    """Whether at least ``similarity`` of the tokens are the same."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return same >= _needed(a, similarity)


def _needed(tokens: Column | str, similarity: float) -> Column:
    return F.ceil(F.lit(similarity) * F.size(tokens) - 1e-9).cast("int")


def _blocks(tokens: Column, similarity: float) -> Column:
    """Hashes of runs of tokens, one run more than tokens may differ: templates that are alike agree in one at least."""
    size, needed = F.size(tokens), _needed(tokens, similarity)
    n = size - needed + 1
    edge = lambda i: F.floor(i * size / n).cast("int")
    runs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.slice(tokens, edge(i) + 1, edge(i + 1) - edge(i))))
    return F.when(needed > 0, runs).otherwise(F.array(F.lit(0).cast("long")))


def _lead() -> Column:
    """What is kept of a template: its rank (by falling documents, then first line), and the documents that hold it."""
    rank = F.struct("docs", (-F.col("first")).alias("d"), (-F.col("pos")).alias("p"), "tmpl")
    return F.struct(rank.alias("rank"), "tmpl", "docs", "first", "last", "tokens")


def _plain(x: Column) -> Column:
    return F.struct(*(x[c].alias(c) for c in ("tmpl", "docs", "first", "last")))


def generalised(held: DataFrame, similarity: float) -> DataFrame:
    """(leaf, own, into): each template that is like a leading one of its leaf, with the first of those; both are (tmpl,
    docs, first, last).

    held: (leaf, of, tmpl, docs, first, last, pos, tokens); of is the number of the leaf's templates. By falling rank, a
    template leads unless it is like a leading one before it. The first templates of each leaf, as many as make WORK
    comparisons, are worked on as one array. In larger leaves the others then meet the leading ones found, in runs of
    tokens that they share; those that are like none are the next array. So rounds are templates of a leaf that are like
    none before their block, by the size of an array.
    """
    few = F.col("of") * F.col("of") * F.size("tokens") <= WORK
    rows = held.select("leaf", _lead().alias("x"), few.alias("few"))
    merged = _folded(rows.filter("few"), similarity).select("leaf", F.explode("out").alias("m"))
    left = rows.filter(~F.col("few")).select("leaf", "x")
    if left.isEmpty():
        return merged.select("leaf", "m.own", "m.into")
    parts = [merged]
    place = F.dense_rank().over(Window.partitionBy("leaf").orderBy(F.col("x.rank").desc()))
    while not left.isEmpty():
        numbered = left.withColumn("place", place)
        most = F.greatest(F.sqrt(F.lit(WORK) / F.greatest(F.size("x.tokens"), F.lit(1))), F.lit(1))
        numbered = gathered(numbered.select("leaf", "x", (F.col("place") <= most).alias("now")))
        folded = gathered(_folded(numbered.filter("now"), similarity))
        rest = numbered.filter(~F.col("now"))
        runs = lambda rows: rows.select("leaf", "x", F.posexplode(_blocks(F.col("x.tokens"), similarity)).alias("b", "h"))
        leads = runs(folded.select("leaf", F.explode("leads").alias("x"))).groupBy("leaf", "b", "h").agg(F.collect_list("x").alias("leads"))
        met = hot_join(runs(rest), leads, ["leaf", "b", "h"], ["x"])
        alike = F.filter("leads", lambda lead: _alike(lead["tokens"], F.col("x.tokens"), similarity))
        met = met.select("leaf", "x", F.array_max(alike).alias("into")).filter("into is not null")
        found = gathered(met.groupBy("leaf", "x.tmpl").agg(F.struct(F.first(_plain(F.col("x"))).alias("own"), _plain(F.max("into")).alias("into")).alias("m")))
        parts += [folded.select("leaf", F.explode("out").alias("m")), found.select("leaf", "m")]
        gone = found.select("leaf", F.col("m.own.tmpl").alias("tmpl"))
        left = gathered(rest.withColumn("tmpl", F.col("x.tmpl")).join(gone, ["leaf", "tmpl"], "left_anti").select("leaf", "x"))
    return reduce(DataFrame.unionByName, parts).select("leaf", "m.own", "m.into")


def _folded(rows: DataFrame, similarity: float) -> DataFrame:
    """(leaf, leads, out) of rows (leaf, x): the leading templates, and (own, into) of the others."""
    kind = rows.schema["x"].dataType
    slim = StructType([f for f in kind.fields if f.name in ("tmpl", "docs", "first", "last")])
    none = StructType([StructField("own", slim), StructField("into", slim)])
    start = F.struct(F.array().cast(ArrayType(kind)).alias("leads"), F.array().cast(ArrayType(none)).alias("out"))

    def step(held: Column, x: Column) -> Column:
        def placed(lead: Column) -> Column:
            new = lead.isNull()
            out = F.concat(held["out"], F.array(F.struct(_plain(x).alias("own"), _plain(lead).alias("into"))))
            return F.struct(F.when(new, F.concat(held["leads"], F.array(x))).otherwise(held["leads"]).alias("leads"), F.when(new, held["out"]).otherwise(out).alias("out"))

        return _let(F.get(F.filter(held["leads"], lambda lead: _alike(lead["tokens"], x["tokens"], similarity)), F.lit(0)), placed)

    # Rows repeat where one id has several texts.
    own = rows.groupBy("leaf").agg(F.sort_array(F.collect_set("x"), asc=False).alias("own"))
    return own.select("leaf", F.aggregate("own", start, step).alias("all")).select("leaf", "all.leads", "all.out")


def recurring(docs: DataFrame, lines: DataFrame, id_col: str, text_col: str, min_docs: int, similarity: float) -> DataFrame:
    """(leaf, tmpl, first, n): templates that recur, as themselves or by what they generalise to, with the first document
    and the number of documents that hold the template itself."""
    per_doc = lines.groupBy("leaf", "tmpl", "doc").agg(F.min("pos").alias("pos"))
    told = [F.count("*").alias("docs"), F.min("doc").alias("first"), F.max("doc").alias("last"), F.min_by("pos", "doc").alias("pos")]
    found = gathered(per_doc.groupBy("leaf", "tmpl").agg(*told))

    # Leaves with several templates, and those that are like leading ones.
    mixed = gathered(found.groupBy("leaf").agg(F.count("*").alias("n")).filter("n > 1"))
    several = sized_join(found, mixed.select("leaf", F.col("n").alias("of")), ["leaf"], ["tmpl"], 24, counts=mixed)
    held = gathered(template_tokens(docs, gathered(several), id_col, text_col))
    merged = gathered(generalised(held, similarity))

    least = max(2, min_docs)
    ends = [F.min(F.least("own.first", "into.first")).alias("first"), F.max(F.greatest("own.last", "into.last")).alias("last")]
    groups = gathered(merged.groupBy("leaf", "into").agg(F.max(F.greatest("own.docs", "into.docs")).alias("most"), *ends, F.count("*").alias("n")))
    sure = groups.filter((F.col("most") >= least) | (F.lit(least == 2) & (F.col("first") < F.col("last")))).select("leaf", "into", "first", "n")
    members = merged.select("leaf", F.col("own.tmpl").alias("tmpl"), "into", F.col("own.docs").alias("docs"))
    leads = groups.select("leaf", F.col("into.tmpl").alias("tmpl"), "into", F.col("into.docs").alias("docs"))
    if least > 2:  # of templates that all have fewer documents the different ones are counted
        rare = members.unionByName(leads).join(groups.filter(F.col("most") < least).select("leaf", "into"), ["leaf", "into"])
        counted = lines.select("leaf", "tmpl", "doc").join(rare, ["leaf", "tmpl"]).groupBy("leaf", "into").agg(F.countDistinct("doc").alias("docs"), F.min("doc").alias("first"))
        counted = counted.filter(F.col("docs") >= least).join(groups.select("leaf", "into", "n"), ["leaf", "into"])
        sure = gathered(sure.unionByName(counted.select("leaf", "into", "first", "n")))
    taken = members.select("leaf", "tmpl").unionByName(leads.select("leaf", "tmpl"))
    alone = found.filter(F.col("docs") >= least).select("leaf", "tmpl", "first", F.col("docs").alias("n"))
    alone = alone.join(F.broadcast(taken) if small(merged, 16) else taken, ["leaf", "tmpl"], "left_anti")
    united = sized_join(members, sure.drop("n"), ["leaf", "into"], ["tmpl"], 64, counts=sure)
    firsts = sure.select("leaf", F.col("into.tmpl").alias("tmpl"), "first", F.col("into.docs").alias("n"))
    return gathered(alone.unionByName(united.select("leaf", "tmpl", "first", F.col("docs").alias("n"))).unionByName(firsts))


def _shingles(text: Column) -> Column:
    """32-bit hashes of the different runs of SHINGLE words; a text of fewer words has one, all of it."""

    def cut(hashes: Column) -> Column:
        n = F.size(hashes)
        run = lambda i: F.hash(*(F.get(hashes, i + j) for j in range(SHINGLE)))
        return F.when(n < SHINGLE, F.array(F.hash(hashes))).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0))), run))

    words = F.filter(F.split(F.lower(text), r"[ \t\n\x0b\f\r]+"), lambda w: w != "")
    return F.array_distinct(_let(F.transform(words, lambda w: F.xxhash64(w)), cut))


def _near_copies(docs: DataFrame, lines: DataFrame, hit: DataFrame, id_col: str, text_col: str, copies: float) -> DataFrame:
    """(doc, key) of documents like one that keeps lines of theirs, by the shingles of whole texts.

    A document is compared with each keeper of at least COPIED of its tokens, of which there are 1 / COPIED at most.
    """
    shared = hit.groupBy("doc", "key", "first").agg(F.sum("n").alias("s"))
    tokens = gathered(lines.groupBy("doc", "key").agg(F.sum("n").alias("tokens")))
    pairs = gathered(shared.join(tokens, ["doc", "key"]).filter(F.col("s") >= COPIED * F.col("tokens")))
    others = tokens.select(F.col("doc").alias("first"), F.col("key").alias("other"), F.col("tokens").alias("theirs"))
    pairs = hot_join(pairs, others, ["first"], ["doc", "key"]).filter(F.col("s") >= COPIED * F.col("theirs"))
    pairs = gathered(pairs.select("doc", "key", "first", "other"))
    wanted = pairs.select("doc", "key").unionByName(pairs.select(F.col("first").alias("doc"), F.col("other").alias("key"))).distinct()
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    texts = join_checked(texts, gathered(wanted), ["doc", "key"], "left_semi", 32)
    sets = gathered(texts.select("doc", "key", _shingles(F.col("text")).alias("a")))
    both = pairs.join(sets, ["doc", "key"])
    theirs = sets.select(F.col("doc").alias("first"), F.col("key").alias("other"), F.col("a").alias("b"))
    both = hot_join(both, theirs, ["first", "other"], ["doc", "key"], counts=pairs.groupBy("first", "other").agg(F.count("*").alias("n")))
    both = both.withColumn("same", F.size(F.array_intersect("a", "b")))
    alike = F.col("same") >= F.lit(copies) * (F.size("a") + F.size("b") - F.col("same")) - 1e-9
    return both.filter(alike).select("doc", "key").distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_tokens: int = 4, min_docs: int = 2, similarity: float = 0.7, copies: float | None = None) -> DataFrame:
    """``docs`` with the recurring lines taken out of ``text_col``, n_lines long and dropped array<int> (their positions).

    copies: documents at least so similar to the one that keeps their lines are left whole (None: all are deduplicated).
    """
    lines = gathered(template_lines(docs, id_col, text_col, max(1, min_tokens)))
    again = recurring(docs, lines, id_col, text_col, min_docs, similarity)
    held = F.broadcast(again.drop("n")) if small(again, 40) else None
    hit = lines.join(held, ["leaf", "tmpl"]) if held is not None else hot_join(lines, again.drop("n"), ["leaf", "tmpl"], ["doc", "pos"], counts=again)
    hit = hit.filter("doc <> first")
    gone = hit.groupBy("doc", "key").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    if copies is not None:
        gone = gone.join(_near_copies(docs, lines, hit, id_col, text_col, copies), ["doc", "key"], "left_anti")
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "dropped")]
    doc, key = fresh("_doc", docs), fresh("_key", docs)
    rows = docs.select(*keep, F.col(id_col).cast("long").alias(doc), F.xxhash64(text_col).alias(key))
    out = rows.join(gone.select(F.col("doc").alias(doc), F.col("key").alias(key), "dropped"), [doc, key], "left")
    left = lambda parts: F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("dropped"))
    kept = _let(F.split(text_col, "\n"), lambda parts: F.array_join(F.transform(left(parts), lambda i: F.get(parts, i)), "\n"))
    text = F.when(F.col("dropped").isNull(), F.col(text_col)).otherwise(kept)
    none = F.array().cast("array<int>")
    return out.select(*(text.alias(c) if c == text_col else F.col(c) for c in keep), F.coalesce(F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"), F.coalesce("dropped", none).alias("dropped"))
