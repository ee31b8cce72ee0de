"""Column expressions on paths and texts: kinds, chunks, locators, snippets."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CHUNK_LIMIT, CHUNK_OVERLAP, EXTENSIONS, LEAST_LIMIT, SEGMENT_S, SNIPPET, TEXT_CAP


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension; empty if the file name has none."""
    return F.lower(F.regexp_extract(basename(path), r"[^.]\.([^.]+)$", 1))


def kind_of(path: Column) -> Column:
    """Kind by extension, null if it is none of the known ones."""
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable((e, k) for k, es in EXTENSIONS.items() for e in es)))
    return F.element_at(table, extension(path))


def governing(kind: Column) -> Column:
    """The kind whose switch governs: text for scanned pages."""
    return F.when(kind == "scan", F.lit("text")).otherwise(kind)


def decode(content: Column, cap: int = TEXT_CAP) -> Column:
    """The first ``cap`` bytes as UTF-8; as Latin-1 if they are not. A character cut by the cap is dropped."""
    head = F.substring(content, 1, cap)
    tries = [head, *(F.when(F.octet_length(content) >= cap, F.substring(content, 1, cap - k)) for k in (1, 2, 3))]
    return F.coalesce(*(F.try_validate_utf8(t.cast("string")) for t in tries), F.decode(head, "ISO-8859-1"))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def chunk_count(n: Column, limit: int = CHUNK_LIMIT) -> Column:
    """Windows that a text of ``n`` characters takes."""
    limit = max(LEAST_LIMIT, limit)
    step = max(1, limit - CHUNK_OVERLAP)
    return F.when(n <= limit, 1).otherwise(F.ceil((n - limit) / step) + 1).cast("int")


def _feeds(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def line_locator(text: Column, start: Column) -> Column:
    """"Line n" of one place in a text."""
    return F.concat(F.lit("Line "), (_feeds(F.substring(text, F.lit(1), start)) + 1).cast("string"))


def expects_preview(path: Column, kind: Column, locator: Column) -> Column:
    """Whether a chunk has a picture to show: a segment of a video, or a page of a PDF."""
    pdf = F.coalesce(page_index(locator) >= 0, F.lit(False)) & (extension(path) == "pdf")
    return F.when(kind == "video", clock_seconds(locator).isNotNull()).otherwise(pdf)


def extensions_of(kind: str) -> list[str]:
    """The extensions of a kind, sorted; a scan has none of its own."""
    return sorted(EXTENSIONS.get(kind, ()))


def page_locator(starts: Column, start: Column) -> Column:
    """"Page n" of the last page that starts at or before ``start``."""
    return F.concat(F.lit("Page "), F.greatest(F.size(F.filter(starts, lambda s: s <= start)), F.lit(1)).cast("string"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used: an expression inside a lambda is worked out again for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running_sums(values: Column, group: int = 512) -> Column:
    """Before each whole number of an array, the sum of those before it; by groups, so that no long array is copied for each element."""
    start = F.array(F.lit(0)).cast("array<int>")
    grow = lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))
    firsts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(group))

    def joined(within: Column) -> Column:
        offsets = F.aggregate(F.transform(within, lambda w: F.element_at(w, -1)), start, grow)
        return _once(offsets, lambda o: F.flatten(F.transform(within, lambda w, g: F.transform(F.slice(w, F.lit(1), F.size(w) - 1), lambda x: x + F.get(o, g)))))

    return _once(values, lambda v: _once(F.transform(firsts, lambda at: F.aggregate(F.slice(v, at, F.lit(group)), start, grow)), joined))


def chunks(text: Column, limit: int = CHUNK_LIMIT, pages: Column | None = None, plain: bool = True) -> Column:
    """Windows (chunk_index, start, text, locator) of ``text``; a text that fits in one has locator ''.

    The text is cut into steps once; a window joins the steps that it covers, and
    its line comes from the line feeds of the steps before it.
    """
    limit = max(LEAST_LIMIT, limit)
    step = max(1, limit - CHUNK_OVERLAP)
    n = chunk_count(F.length(text), limit)
    covered = -(-limit // step)

    def windows(steps: Column, before: Column | None) -> Column:
        def window(i: Column) -> Column:
            start = i * step
            own = F.substring(F.array_join(F.slice(steps, i + 1, F.lit(covered)), ""), 1, limit)
            where = page_locator(pages, start) if pages is not None else F.concat(F.lit("Line "), (F.get(before, i) + 1).cast("string")) if before is not None else F.lit("")
            return F.struct(i.alias("chunk_index"), start.alias("start"), own.alias("text"), F.when(n == 1, F.lit("")).otherwise(where).alias("locator"))

        return F.transform(F.sequence(F.lit(0), n - 1), window)

    steps = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % step), F.lit(0))
    if pages is not None or not plain:
        return _once(steps, lambda s: windows(s, None))
    return _once(steps, lambda s: _once(running_sums(F.transform(s, _feeds)), lambda before: windows(s, before)))


def snippet(text: Column) -> Column:
    """One line of at most 220 characters: runs of line feeds and tabs count as single spaces, those at an end as nothing; spaces of the text stay."""
    clean = F.regexp_replace(F.regexp_replace(text, r"^[\n\t]+|[\n\t]+\z", ""), "[\n\t]+", " ")
    return F.substring(clean, 1, SNIPPET)


def clock(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    s = F.floor(seconds).cast("int")
    h, m, r = F.floor(s / 3600).cast("int"), F.floor(s / 60).cast("int") % 60, s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def clock_seconds(locator: Column) -> Column:
    """Seconds of m:ss or h:mm:ss, null for other locators."""
    parts = F.transform(F.split(locator, ":"), lambda x: x.cast("int"))
    value = F.aggregate(parts, F.lit(0), lambda a, x: a * 60 + x)
    return F.when(locator.rlike(r"^\d+:\d\d(:\d\d)?$"), value)


def page_index(locator: Column) -> Column:
    """Page number from 0 of "Page n"."""
    return F.when(locator.rlike(r"^Page \d+$"), F.regexp_extract(locator, r"(\d+)", 1).cast("int") - 1)


def segments(duration: Column, single: bool = False) -> Column:
    """Segments (chunk_index, start, end, locator) of a medium; ``single``: one without locator if it fits (video)."""
    n = F.greatest(F.lit(1), F.ceil(duration / SEGMENT_S).cast("int"))

    def part(i: Column) -> Column:
        start = i * SEGMENT_S
        where = clock(start.cast("double"))
        where = F.when(n == 1, F.lit("")).otherwise(where) if single else where
        return F.struct(i.alias("chunk_index"), start.cast("double").alias("start"), F.least(duration, (start + SEGMENT_S).cast("double")).alias("end"), where.alias("locator"))

    return F.transform(F.sequence(F.lit(0), n - 1), part)


def scan_pages(page_count: Column) -> Column:
    """A chunk (chunk_index, locator) for each page of a scanned document; one page has locator ''."""
    return F.transform(F.sequence(F.lit(0), page_count - 1), lambda i: F.struct(i.alias("chunk_index"), F.when(page_count > 1, F.concat(F.lit("Page "), (i + 1).cast("string"))).otherwise(F.lit("")).alias("locator")))


def paged_text(pages: Column) -> Column:
    """(text, page_starts, scanned) of page texts: pages end in a line feed; few characters a page mean a scan."""
    ended = F.transform(pages, lambda p: F.when(p.endswith("\n"), p).otherwise(F.concat(p, F.lit("\n"))))
    starts = running_sums(F.transform(ended, F.length))
    text = F.array_join(ended, "")
    return F.struct(text.alias("text"), starts.alias("page_starts"), (F.length(trim(text)) < F.size(pages) * 8).alias("scanned"))


def token_estimate(texts: Column) -> Column:
    """Sum over the texts of their words, each at least one."""
    words = F.transform(texts, lambda t: F.greatest(F.lit(1), F.size(F.filter(F.split(t, "[ \n\t]"), lambda w: w != ""))))
    return F.aggregate(words, F.lit(0), lambda a, x: a + x)


def content_key(kind: Column, path: Column, content: Column, dim: int, fingerprint: str) -> Column:
    """Key under which equal contents share vectors; texts hash their first 2 MB."""
    digest = F.sha2(F.when(kind == "text", F.substring(content, 1, TEXT_CAP)).otherwise(content), 256)
    return F.concat_ws("|", F.lit("1"), kind, extension(path), F.lit(f"m{dim}"), F.lit(fingerprint), digest)
