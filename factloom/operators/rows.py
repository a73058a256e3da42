"""Data rows joined to their headers by position, and summary rows told apart, as column expressions over the table's arrays.

A table is one row of the frame, so that nothing is shuffled, and all is done
where refinement is, without another pass through Python.

``compat`` mode: a data row is cut into pieces as long as the headers, and each
piece is a row. A piece that is shorter leaves its row open: it and the pieces up
to and with the next that is not shorter are one and the same row, once for each
piece, with the last cell that any of them has in a place. ``clean`` mode:
surplus cells are cut off and short rows are short. Of headers with one name the
last counts, in the place of the first.

Summary rows: row ``t`` is judged by the values of row ``t + d``, ``d`` being the
rows removed before it. Each column has a running sum, which begins with its first
number; a number that is the sum, or to 12 digits the mean over the rows kept so far,
matches, and any other is added. The first two rows of a longer table match
nothing. Row ``t`` is removed if two columns match and it names something else
than the last row kept: it has no column more, and some text of it is far from
the one there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import letter_distance, once, to_float

#: Matching columns, and distance of the texts, from which on a row is a summary.
MATCHES, DISTANCE = 2, 7
_ROWS = "array<struct<row_ord:int,removed:boolean,cells:array<struct<header:string,value:string,empty:boolean,links:array<string>>>>>"
#: Two numbers may be one to 12 digits only if they are as near as this part of them.
NEAR = 1e-10


def _upto(n: Column) -> Column:
    """The places 0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _cell(header: Column, c: Column) -> Column:
    """A cell under a header: its value is its number, its text or else its last link."""
    value = F.coalesce(c["shown"], F.nullif(c["text"], F.lit("")), F.get(c["links"], F.size(c["links"]) - 1), F.lit(""))
    empty = F.coalesce(F.coalesce(F.get(c["links"], F.lit(0)), c["text"]) == "-", F.lit(False))
    return F.struct(header.alias("header"), value.alias("value"), empty.alias("empty"), c["links"].alias("links"))


def _even(row: Column, headers: Column) -> Column:
    """Cells of a row under headers that are all different."""
    return F.transform(row, lambda c, p: _cell(F.get(headers, p), c))


def _named(entries: Column, headers: Column) -> Column:
    """Entries (piece, cell) by place as cells by name: of one name the entry of the last piece, and there of the last place."""
    names = F.slice(headers, F.lit(1), F.size(entries))
    last = lambda h: F.array_max(F.transform(F.filter(_upto(F.size(entries)), lambda p: F.get(headers, p) == h), lambda p: F.struct(F.get(entries, p)["piece"].alias("piece"), p.alias("p"))))
    plain = F.transform(entries, lambda x, p: _cell(F.get(headers, p), x["cell"]))
    return F.when(F.size(F.array_distinct(names)) == F.size(names), plain).otherwise(F.transform(F.array_distinct(names), lambda h: _cell(h, F.get(entries, last(h)["p"])["cell"])))


def _laid_over(run: Column) -> Column:
    """By place, the cell of the last of a run's pieces that reaches it."""
    last = lambda p: F.array_max(F.transform(run, lambda c, i: F.when(F.size(c) > p, i)))
    entry = lambda p: once(last(p), lambda k: F.struct(k.alias("piece"), F.get(F.get(run, k), p).alias("cell")))
    return F.transform(_upto(F.array_max(F.transform(run, F.size))), entry)


def joined_rows(headers: Column, data: Column, mode: str = "compat") -> Column:
    """Rows of cells (header, value, empty, links)."""
    width = F.size(headers)
    different = F.size(F.array_distinct(headers)) == width
    if mode == "clean":
        entries = lambda row: F.transform(F.slice(row, F.lit(1), width), lambda c: F.struct(F.lit(0).alias("piece"), c.alias("cell")))
        return F.when(different, F.transform(data, lambda row: _even(F.slice(row, F.lit(1), width), headers))).otherwise(F.transform(data, lambda row: once(entries(row), lambda x: _named(x, headers))))

    def of_runs(pieces: Column, ends: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(F.slice(ends, F.lit(1), F.size(ends) - 1), lambda e: e + 1))
        runs = F.zip_with(starts, ends, lambda s, e: F.slice(pieces, s + 1, e - s + 1))
        return F.flatten(F.transform(runs, lambda run: F.array_repeat(once(_laid_over(run), lambda x: _named(x, headers)), F.size(run))))

    def of_pieces(pieces: Column) -> Column:
        n = F.size(pieces)
        ends = F.filter(_upto(n), lambda i: (F.size(F.get(pieces, i)) == width) | (i == n - 1))
        return once(ends, lambda found: of_runs(pieces, found))

    pieces = F.flatten(F.transform(data, lambda row: F.transform(_upto(F.ceil(F.size(row) / width).cast("int")), lambda k: F.slice(row, k * width + 1, width))))
    # rows as long as headers that are all different are their own pieces
    plain = different & F.forall(data, lambda row: F.size(row) == width)
    return F.when(plain, F.transform(data, lambda row: _even(row, headers))).otherwise(once(pieces, of_pieces))


def _same(number: Column, total: Column, kept: Column) -> Column:
    """Whether a number is the sum, or to 12 digits the mean."""
    mean = total / kept
    digits = lambda x: F.format_string("%.11e", x)
    return (number == total) | ((kept > 0) & (F.abs(number - mean) <= F.abs(number) * NEAR) & (digits(number) == digits(mean)))


def removed_places(joined: Column, numbers: Column, width: Column) -> Column:
    """The places of the summary rows; ``numbers`` are the values as numbers, null where they are none, ``width`` the most columns."""
    n = F.size(joined)

    def differs(t: Column, before: Column) -> Column:
        now, above = F.get(joined, t), F.get(joined, before)
        number = lambda i, k: F.get(F.get(numbers, i), k)
        far = lambda k: number(t, k).isNull() & number(before, k).isNull() & (letter_distance(F.get(now, k)["value"], F.get(above, k)["value"]) >= DISTANCE)
        return F.coalesce((F.size(now) <= F.size(above)) & F.exists(_upto(F.size(now)), far), F.lit(False))

    def step(state: Column, t: Column) -> Column:
        kept = t - state["skipped"]
        may = (kept > 1) | (n - state["skipped"] <= 2)

        def column(total: Column, number: Column) -> Column:
            match = F.coalesce(_same(number, total, kept) & may, F.lit(False))
            after = F.when(number.isNull() | match, total).when(total.isNull(), number).otherwise(total + number)
            return F.struct(after.alias("total"), match.alias("match"))

        looked = F.zip_with(state["totals"], F.coalesce(F.get(numbers, t + state["skipped"]), F.array().cast("array<double>")), column)

        def judged(columns: Column) -> Column:
            gone = F.when(F.size(F.filter(columns, lambda c: c["match"])) >= MATCHES, differs(t, state["before"])).otherwise(F.lit(False))
            return once(
                gone,
                lambda out: F.struct(
                    (state["skipped"] + out.cast("int")).alias("skipped"),
                    F.when(out, state["before"]).otherwise(t).alias("before"),
                    F.transform(columns, lambda c: c["total"]).alias("totals"),
                    F.when(out, F.concat(state["places"], F.array(t))).otherwise(state["places"]).alias("places"),
                ),
            )

        return once(looked, judged)

    start = F.struct(F.lit(0).alias("skipped"), F.lit(-1).alias("before"), F.array_repeat(F.lit(None).cast("double"), width).alias("totals"), F.array().cast("array<int>").alias("places"))
    return F.aggregate(_upto(n), start, step, lambda state: state["places"])


def table_rows(refined: DataFrame, mode: str = "compat", drop_summaries: bool = True) -> DataFrame:
    """Refined tables of status OK with ``rows``: each with its order, whether it is removed, and its cells.

    All of it is one expression that names each of its columns once, so that no
    part of it is computed again where filters on the rows are pushed below it.
    """
    tables = refined.where("status = 'OK'").drop("header_grid", "data_raw", "headers_raw")

    def rows(joined: Column, places: Column) -> Column:
        return F.transform(joined, lambda row, i: F.struct(i.alias("row_ord"), F.array_contains(places, i).alias("removed"), row.alias("cells")))

    def judged(joined: Column, headers: Column) -> Column:
        if not drop_summaries:
            return rows(joined, F.array().cast("array<int>"))
        numbers = F.transform(joined, lambda row: F.transform(row, lambda c: to_float(c["value"])))
        # a summary matches in so many numbers, so a table without a row of these has none
        some = lambda found: F.exists(found, lambda row: F.size(F.filter(row, lambda x: x.isNotNull())) >= MATCHES)
        places = lambda found: F.when(some(found), removed_places(joined, found, F.size(headers))).otherwise(F.array().cast("array<int>"))
        return once(numbers, lambda found: once(places(found), lambda gone: rows(joined, gone)))

    found = once(F.col("headers"), lambda headers: F.when(F.size(headers) > 0, once(joined_rows(headers, F.col("data"), mode), lambda joined: judged(joined, headers))).otherwise(F.array().cast(_ROWS)))
    return tables.select(*(c for c in tables.columns if c != "data"), found.alias("rows"))
