"""Packing of paragraphs into chunks, and lines into paragraphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import indices, split_words
from ..functions.text import n_tokens, once, sentences, tokens


def pack(parts: Column, sizes: Column, pack_limit: int) -> Column:
    """array<array<string>>: greedy groups; a part that would lift a group above the limit begins the next one.

    The cut depends on what the group already holds, so this is a fold over the document's own array.
    """
    start = F.struct(F.lit(0).cast("long").alias("size"), F.array().cast("array<string>").alias("open"), F.array().cast("array<array<string>>").alias("done"))

    def step(acc, x):
        over = (F.size(acc["open"]) > 0) & (acc["size"] + x["n"] > pack_limit)
        return F.struct(
            F.when(over, x["n"]).otherwise(acc["size"] + x["n"]).cast("long").alias("size"),
            F.when(over, F.array(x["p"])).otherwise(F.concat(acc["open"], F.array(x["p"]))).alias("open"),
            F.when(over, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
        )

    items = F.zip_with(parts, sizes, lambda p, n: F.struct(p.alias("p"), n.cast("long").alias("n")))
    return F.aggregate(items, start, step, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


Count = Callable[[Column], Column]


def split_paragraph(text: Column, pack_limit: int, count: Count = n_tokens) -> Column:
    """array<string>: a long paragraph's sentences packed likewise, joined by a space; longer sentences are cut into even word groups first."""
    pieces = F.flatten(F.transform(sentences(text), lambda s: F.when(count(s) > pack_limit, F.transform(split_words(tokens(s), pack_limit), lambda ws: F.array_join(ws, " "))).otherwise(F.array(s))))
    return F.transform(pack(pieces, F.transform(pieces, count), pack_limit), lambda g: F.array_join(g, " "))


def chunk_documents(docs: DataFrame, doc_id: str, text: str, pack_limit: int = 600, split_limit: int = 800, separator: str = "\n", count: Count = n_tokens) -> DataFrame:
    """(doc_id, chunk_pos, chunk): paragraphs packed up to pack_limit tokens; one of split_limit or more stands alone, split by sentences.

    count gives a text's tokens, as the tokenizers of `functions.tokenizers` that stay in the JVM do; sentences above the limit are cut between words.
    """
    paragraphs = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), separator), lambda p: F.trim(p) != "")
    start = F.struct(F.lit(0).cast("long").alias("size"), F.array().cast("array<string>").alias("open"), F.array().cast("array<string>").alias("done"))
    joined = lambda xs: F.array_join(xs, separator)

    def flush(acc):
        return F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(joined(acc["open"])))).otherwise(acc["done"])

    def step(acc, x):
        p, n = x["p"], x["n"]  # counted once, before the fold
        long_, over = n >= split_limit, acc["size"] + n > pack_limit
        nothing = F.array().cast("array<string>")
        return F.struct(
            F.when(long_, 0).when(over, n).otherwise(acc["size"] + n).cast("long").alias("size"),
            F.when(long_, nothing).when(over, F.array(p)).otherwise(F.concat(acc["open"], F.array(p))).alias("open"),
            F.when(long_, F.concat(flush(acc), split_paragraph(p, pack_limit, count))).when(over, flush(acc)).otherwise(acc["done"]).alias("done"),
        )

    counted = F.transform(paragraphs, lambda p: F.struct(p.alias("p"), count(p).alias("n")))
    chunks = F.aggregate(counted, start, step, flush)
    return docs.select(doc_id, F.posexplode(chunks).alias("chunk_pos", "chunk")).withColumn("n_tokens", count(F.col("chunk")))


def upper_median(values: Column) -> Column:
    """sorted[n // 2] of an array; null for an empty one."""
    return F.when(F.size(values) > 0, F.try_element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int")))


def is_noise(line: Column) -> Column:
    """Only digits, or at most five characters without a letter."""
    return line.rlike(r"^\d+$") | ((F.length(line) <= 5) & ~line.rlike(r"\p{L}"))


def recurring(lines: DataFrame, doc: str, line: str, least_length: int = 10, least_count: int = 5) -> DataFrame:
    """(doc, line) of the lines that recur in their document."""
    return lines.filter(F.length(line) >= least_length).groupBy(doc, line).agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def merge_paragraphs(paragraphs: DataFrame, doc: str, seq: str, page: str, text: str) -> DataFrame:
    """(doc, para, text): a page's first paragraph joins the previous page's last if that one doesn't end in . ! ? or :"""
    order = Window.partitionBy(doc).orderBy(seq)
    previous, turned = F.lag(text).over(order), F.lag(page).over(order) != F.col(page)
    joins = F.coalesce(turned & (F.coalesce(F.right(F.rtrim(previous), F.lit(1)), F.lit("")).isin(".", "!", "?", ":") == F.lit(False)), F.lit(False))
    marked = paragraphs.withColumn("__new", F.when(joins, 0).otherwise(1)).withColumn("para", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    merged = marked.groupBy(doc, "para").agg(F.array_sort(F.collect_list(F.struct(seq, text))).alias("xs"))
    return merged.select(doc, "para", F.array_join(F.transform("xs", lambda x: x[text]), " ").alias("text"))


#: A paragraph that ends in one of these is finished at the end of a page.
FINISHED = (".", "!", "?", ":")


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value worked out once: inside a lambda, plans would copy the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _cut(items: Column, begins: Callable[[Column, Column], Column], make: Callable[[Column, Column], Column]) -> Column:
    """array of make(run, first index), for runs of items that begin where begins(item, index) holds, and at the first item."""
    first = F.filter(indices(F.size(items)), lambda i: (i == 0) | F.coalesce(begins(F.get(items, i), i), F.lit(False)))
    stop = lambda at, k: F.coalesce(F.get(at, k + 1), F.size(items))
    return _with(first, lambda at: F.transform(at, lambda i, k: make(F.slice(items, i + 1, stop(at, k) - i), i)))


def page_lines(words: Column, gap: float = 3.0, height: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<txt, at>>: the lines of a page's words in order, struct<word, top>: words whose heights differ by less than
    `gap` from the word before share a line. at is the first word's height, or what `height` makes of an array of all."""
    own = lambda run: F.get(run, F.lit(0))["top"] if height is None else height(F.transform(run, lambda w: w["top"]))
    apart = lambda ws: lambda w, i: F.abs(w["top"] - F.get(ws, i - 1)["top"]) >= gap
    line = lambda run, i: F.struct(F.array_join(F.transform(run, lambda w: w["word"]), " ").alias("txt"), own(run).alias("at"))
    return _with(words, lambda ws: _cut(ws, apart(ws), line))


def lines_to_text(pages: Column, spread: float = 1.5, single: float = 20.0, least: int = 5, least_length: int = 10, least_count: int = 5) -> Column:
    """A document's content from array<struct<lines>>, its pages in order with their `page_lines`; null without a paragraph that stays.

    A document is one row and its lines are sorted, not compared with each other. A page begins with an empty mark (line -1), so
    that it has a first paragraph even where its lines went.
    """

    def spaced(ls, page, limit):
        space = lambda x, k: x["at"] - F.get(ls, k - 1)["at"]
        rows = F.transform(ls, lambda x, k: F.struct(x["txt"].alias("txt"), page.alias("page"), k.alias("line"), F.coalesce(space(x, k) > limit, F.lit(False)).alias("cut")))
        return F.concat(F.array(F.struct(F.lit("").alias("txt"), page.alias("page"), F.lit(-1).alias("line"), F.lit(True).alias("cut"))), rows)

    def marked(ls, page):
        spaces = F.filter(F.transform(ls, lambda x, k: x["at"] - F.get(ls, k - 1)["at"]), lambda v: v.isNotNull())
        return _with(F.coalesce(spread * upper_median(spaces), F.lit(single)), lambda limit: spaced(ls, page, limit))

    every = F.flatten(F.transform(pages, lambda p, i: _with(p["lines"], lambda ls: marked(ls, i))))

    def again(xs, x, i):
        """Whether the sorted lines hold `least_count` like this one, in whichever of them it stands."""
        same = lambda k: F.coalesce(F.get(xs, k)["txt"] == x["txt"], F.lit(False))
        runs = [same(i - j) & same(i - j + least_count - 1) for j in range(least_count)]
        found = runs[0]
        for run in runs[1:]:
            found = found | run
        return (F.length(x["txt"]) >= least_length) & found

    stays = lambda xs: F.filter(xs, lambda x, i: (x["line"] < 0) | ~(is_noise(F.trim(x["txt"])) | again(xs, x, i)))
    kept = F.array_sort(F.transform(_with(F.array_sort(every), stays), lambda x: F.struct(x["page"].alias("page"), x["line"].alias("line"), x["cut"].alias("cut"), x["txt"].alias("txt"))))

    def paragraph(run, i):
        return F.struct((F.get(run, F.lit(0))["line"] < 0).alias("head"), F.array_join(F.transform(F.filter(run, lambda x: x["line"] >= 0), lambda x: x["txt"]), " ").alias("txt"))

    parts = _with(kept, lambda xs: _cut(xs, lambda x, i: x["cut"], paragraph))
    # whether a paragraph is open shows in its own text: what it joins was open, and an empty one leaves it so
    open_ = lambda p: (F.trim(p["txt"]) == "") | ~F.right(F.trim(p["txt"]), F.lit(1)).isin(*FINISHED)
    text = lambda run, i: F.array_join(F.transform(run, lambda p: p["txt"]), " ")
    merged = _with(parts, lambda ps: _cut(ps, lambda p, i: ~(p["head"] & open_(F.get(ps, i - 1))), text))
    long_ = F.transform(F.filter(merged, lambda p: F.length(p) > least), lambda p: F.regexp_replace(p, r"\s+", " "))
    return F.nullif(F.array_join(long_, "\n\n"), F.lit(""))


def page_words_to_text(words: DataFrame, doc: str, page: str, seq: str, word: str, top: str, gap: float = 3.0, spread: float = 1.5, single: float = 20.0, least: int = 5) -> DataFrame:
    """(doc, content): words with heights to lines, paragraphs and text.

    A page's words form lines (`page_lines`). Lines that are noise or recur in the document go. A kept line
    begins a paragraph if its distance to the line before it on the page, kept or not, is over `spread` times
    the page's upper median (`single` for a page of one line). A page's first paragraph, which is empty where
    its lines went, joins the previous page's last unless that is finished. Paragraphs of at most `least`
    characters go; white space collapses; an empty line separates paragraphs. Words shuffle once, by page; a
    document's lines follow. Where words are at hand by page, `pages_to_text` takes them without a shuffle.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(seq, F.col(word).alias("word"), F.col(top).alias("top")))), lambda w: F.struct(w["word"].alias("word"), w["top"].alias("top")))
    lined = words.groupBy(doc, page).agg(ordered.alias("ws")).select(doc, page, page_lines(F.col("ws"), gap).alias("lines"))
    packed = lined.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(page, "lines"))).alias("pages"))
    return _content(packed, doc, F.col("pages"), spread, single, least)


def pages_to_text(docs: DataFrame, doc: str, pages: Column, gap: float = 3.0, spread: float = 1.5, single: float = 20.0, least: int = 5) -> DataFrame:
    """`page_words_to_text` for a row a document, whose pages are array<array<struct<word, top>>>, all in order: no shuffle. Pages without words are no pages."""
    held = F.transform(F.filter(pages, lambda p: F.size(p) > 0), lambda p: F.struct(page_lines(p, gap).alias("lines")))
    return _content(docs, doc, held, spread, single, least)


def _content(docs: DataFrame, doc: str, pages: Column, spread: float, single: float, least: int) -> DataFrame:
    return once(docs, "content", lines_to_text(pages, spread, single, least)).select(doc, "content").filter("content IS NOT NULL")
