"""Main text of web pages, by differencing pages with the nearest URLs.

Pages are put in order of host and URL path. Each is aligned, line by line, with the neighbour on its host that shares the longer
beginning of the path (a longest common subsequence), and the lines that both have are deleted: a site's own text stands on all its pages. What
differencing can't tell, the markup does: menus, footers, forms, scripts and classes such as `ad` are out even where they differ from page to page, and lines within an article
or main element are safe from deletion, as articles may share passages. Outside such an element every line stays that is not
shared, but for lines that are links from end to end: all of them beside an article, and in a page without one those that stand together (a menu without markup of its own; a single one is a paragraph). A neighbour that carries the same text (the whole article, or every line of a page without one) says nothing of the
site's: it is passed over for the next one, within a bucket of the order and one
page beyond its ends; where there is none, no line goes. Of a page without an article, differencing deletes whatever its neighbour has too, however much of the page that is.

The order is made without a window by host, as one host may have a third of the pages: bounds from a sample of the keys cut the order
into buckets, and the last and first page of each bucket, found by an aggregation, go to the neighbouring bucket as well.

Defined results: null or empty pages have an empty text; very long pages are read whole; pages with a null or odd URL have the empty host; pages of equal URLs are in
order of page_id, and repeated rows are copies, each judged by the next page that differs; a page alone on its host is judged by its markup; an empty table gives an empty one; other columns stay, columns named text are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import bound_batches, free_name, tasks_for
from lodestone.llm.html_blocks import Line, common_lines, page_lines
from lodestone.llm.neighbours import position, rows_of_bucket, sampled_cuts

#: Pages of a bucket at least (beyond, see rows_of_bucket), and sampled keys for each.
BUCKET_PAGES, SAMPLE = 500, 10
_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)"


def open_lines(lines: list[Line]) -> list[int]:
    """Positions of the lines that a neighbour may delete: those outside an article."""
    return [k for k, x in enumerate(lines) if not x.content]


def shared_lines(lines: list[Line], near: list[Line]) -> set[int]:
    """Positions of the lines that the other page has too."""
    return common_lines([x.text for x in lines], [x.text for x in near])


def is_copy(lines: list[Line], near: list[Line]) -> bool:
    """Whether near carries the same text: the whole article, or all lines of a page without one. Not asked of pages with nothing open to deletion."""
    if not open_lines(lines):
        return False
    shared = shared_lines(lines, near)
    article = [k for k, x in enumerate(lines) if x.content]
    return shared.issuperset(article or range(len(lines)))


def menu_lines(lines: list[Line]) -> set[int]:
    """Positions of lines outside an article that are links from end to end and so a menu: all beside an article, two or more in a row in a page without one."""
    links = {k for k, x in enumerate(lines) if not x.content and x.linked >= 1}
    return links if any(x.content for x in lines) else {k for k in links if k - 1 in links or k + 1 in links}


def main_lines(lines: list[Line], near: list[Line] | None) -> list[str]:
    """The lines of a page that are its main text, given its neighbour's."""
    gone = shared_lines(lines, near) if near and open_lines(lines) and not is_copy(lines, near) else set()
    menu = menu_lines(lines)
    return [x.text for k, x in enumerate(lines) if x.content or (k not in gone and k not in menu)]


def _shared_start(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):  # noqa: B905
        if x != y:
            break
        n += 1
    return n


def ordered_buckets(pages: DataFrame, key: str, bucket: str, ghost: str) -> DataFrame:
    """pages with a bucket number that follows the order of key, and copies (ghost 1) of the pages on either side of each bucket."""
    keys = pages.select(key)
    total = keys.count()
    cuts = sampled_cuts(keys, key, total, rows_of_bucket(total, BUCKET_PAGES), SAMPLE) if total else []
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array(F.lit(""))
    at = position(bounds, len(cuts) + 1, F.col(key)) if cuts else F.lit(1)
    placed = pages.withColumn(bucket, at)
    ends = {r["b"]: (r["low"], r["high"]) for r in placed.groupBy(F.col(bucket).alias("b")).agg(F.min(key).alias("low"), F.max(key).alias("high")).collect()}
    order = sorted(ends)
    after = {b: order[k + 1] if k + 1 < len(order) else None for k, b in enumerate(order)}
    before = {b: order[k - 1] if k else None for k, b in enumerate(order)}
    highest = max(order, default=1)
    row = lambda f: F.array(*[F.lit(f(b)).cast("string") for b in range(1, highest + 1)])
    lows, highs = row(lambda b: ends.get(b, (None, None))[0]), row(lambda b: ends.get(b, (None, None))[1])
    nexts, lasts = row(after.get), row(before.get)
    here = lambda a: F.element_at(a, F.col(bucket))
    copies = F.filter(
        F.array(
            F.struct(F.col(bucket).alias("b"), F.lit(0).alias("g")),
            F.when(F.col(key) == here(highs), F.struct(here(nexts).cast("int").alias("b"), F.lit(1).alias("g"))),
            F.when(F.col(key) == here(lows), F.struct(here(lasts).cast("int").alias("b"), F.lit(1).alias("g"))),
        ),
        lambda x: x["b"].isNotNull(),
    )
    copy = free_name(pages, "copy")
    return placed.withColumn(copy, F.explode(copies)).withColumn(bucket, F.col(f"{copy}.b")).withColumn(ghost, F.col(f"{copy}.g")).drop(copy)


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """The columns of pages without the page, and text."""
    kept = [f for f in pages.schema.fields if f.name not in (page, "text")]
    names = [f.name for f in kept]
    key, host, path, bucket, ghost = (free_name(pages, n) for n in ("key", "host", "path", "bucket", "ghost"))
    address = F.coalesce(F.col(url), F.lit(""))
    keyed = pages.withColumn(host, F.lower(F.regexp_extract(address, _URL, 1))).withColumn(path, F.regexp_extract(address, _URL, 2))
    keyed = keyed.withColumn(key, F.concat_ws("\x01", host, path, F.lpad(F.coalesce(F.col(page_id).cast("string"), F.lit("")), 20, "0"), address))
    dealt = ordered_buckets(keyed, key, bucket, ghost).select(*names, page, host, path, key, bucket, ghost)
    loaded = dealt.repartition(tasks_for(pages), bucket).sortWithinPartitions(bucket, key, F.col(ghost))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for low in range(0, batch.num_rows, 200):
                    part = batch.slice(low, 200)
                    own = part.select(names)
                    for k, (b, g, h, p, t) in enumerate(zip(*(part.column(c).to_pylist() for c in (bucket, ghost, host, path, page)), strict=True)):
                        yield own.slice(k, 1), b, g, h, p, page_lines(t or "")

        def close(at, prior, next_):
            near = [x for x in (prior, next_) if x is not None]
            near.sort(key=lambda x: -_shared_start(x[4], at[4]))
            return at[0], "\n".join(main_lines(at[5], near[0][5] if near else None))

        done: list = []
        # Pages that wait for the next differing one, each with the differing one before it: a page, or copies in a row.
        held: list[tuple] = []
        for row in rows():
            prior = None
            if held:
                last, before = held[-1]
                near = last[1] == row[1] and last[3] == row[3]
                if near:
                    prior = before if is_copy(row[5], last[5]) else last
                if not (near and is_copy(last[5], row[5])):
                    done += [close(x, y, row if near else None) for x, y in held if not x[2]]
                    held = []
            held.append((row, prior))
            if len(done) >= 200:
                yield emit(done)
                done = []
        done += [close(x, y, None) for x, y in held if not x[2]]
        if done:
            yield emit(done)

    def emit(done: list) -> pa.RecordBatch:
        table = pa.Table.from_batches([d[0] for d in done]).combine_chunks()
        return pa.RecordBatch.from_arrays([*(table.column(n).chunk(0) for n in names), pa.array([d[1] for d in done], pa.string())], names=[*names, "text"])

    bound_batches(pages.sparkSession)
    return loaded.mapInArrow(run, T.StructType([*kept, T.StructField("text", T.StringType())]))
