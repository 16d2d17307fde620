import json
import random
import re
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import pytest

from quillspark.operators import table_analysis as ta

DATE = re.compile(r"^\d{4}-\d{2}-\d{2}(?:\s\d{2}:\d{2}:\d{2})?$")


def letters(n):
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def number(v):
    v = v.strip()
    m = re.match(r"^\(([0-9,.]+)\)$", v)
    v = re.sub("[$,%]", "", "-" + m[1] if m else v)
    return float(v) if re.match(r"^[+-]?(\d+\.?\d*|\.\d+)$", v) else None


def kind(v):
    v = v.strip()
    return "null" if not v else "boolean" if v.upper() in ("TRUE", "FALSE") else "date" if DATE.match(v) else "numeric" if number(v) is not None else "text"


def shape(v):
    marks = ["A" if c.isalpha() else "0" if c.isdigit() else " " if c.isspace() else c for c in v.strip()]
    return "".join(m for i, m in enumerate(marks) if i == 0 or marks[i - 1] != m)


def is_data(values):
    real = [kind(v) for v in values if v.strip()]
    return bool(real) and sum(k != "text" for k in real) * 2 > len(real)


def mode(grid):
    """Of the rows of a region."""
    if is_data(grid[0]):
        return "headerless"
    if len(grid) == 1:
        return "header_row"
    real = [v for v in grid[0] if v.strip()]
    data, header = 0, int(bool(real) and len(set(real)) == len(real))
    for i, v in enumerate(grid[0]):
        first, later = v.strip(), [r[i].strip() for r in grid[1:] if r[i].strip()]
        if not first or not later:
            continue
        usual, own = Counter(map(kind, later)).most_common(1)[0][0], kind(first)
        data += 2 * (first in later)
        if usual == own == "text":
            data += shape(first) in {shape(x) for x in later[:5]}
            header += " " in first or "_" in first or first.isupper() or first.endswith(":")
            header += first not in later and len(set(later[:5])) < len(later[:5])
        elif usual == own:
            data += 1
        else:
            header += 2 if own == "text" and usual in ("numeric", "date", "boolean") else 1
    return "headerless" if data >= header + 1 else "header_row"


def rounded(x, digits):
    """Halves away from zero, as SQL rounds."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def profile(values):
    real = [v for v in values if v.strip()]
    kinds = {kind(v) for v in real}
    dtype = "text" if not kinds else kinds.pop() if len(kinds) == 1 else "mixed"
    numbers, dates, sizes = [number(v) for v in real], sorted(real), [len(v) for v in real]
    stats = {
        "numeric": lambda: (min(numbers), max(numbers), rounded(sum(numbers) / len(numbers), 4)), "date": lambda: (dates[0], dates[-1]), "boolean": lambda: (sum(v.strip().upper() == "TRUE" for v in real), sum(v.strip().upper() != "TRUE" for v in real)),
    }.get(dtype, lambda: (min(sizes), max(sizes), rounded(sum(sizes) / len(sizes), 1), dict(Counter(real)) if len(set(real)) <= 20 else None) if real else ())()
    return dtype, len(real), len(values) - len(real), len(set(real)), stats, list(dict.fromkeys(real))[:5]


def names_of(raw, positions):
    n = Counter(raw)
    return [f"{x} ({p})" if n[x] > 1 and p else x for x, p in zip(raw, positions)]


def assert_profiles(got, want):
    """Equal, but for a last digit of a mean, which depends on the order of adding."""
    near = lambda x: {k: (*v[:6], tuple(y if i != 2 or not isinstance(y, float) else pytest.approx(y, abs=0.11 if v[2] in ("text", "mixed") else 2e-4) for i, y in enumerate(v[6])), v[7]) for k, v in x.items()}
    assert got == near(want)


def got_columns(columns):
    found = {}
    for r in columns.collect():
        stats = {"numeric": (r.min_number, r.max_number, r["mean"]), "date": (r.min_date, r.max_date), "boolean": (r.true_count, r.false_count)}.get(r.dtype)
        stats = stats or ((r.min_length, r.max_length, r.avg_length, r.value_distribution) if r.non_null_count else ())
        found[r.id, r.place] = (r.position, r.name, r.dtype, r.non_null_count, r.null_count, r.unique_count, stats, r.sample_values)
    return found


VALUES = [lambda r: str(r.randrange(5)), lambda r: f"(1,{r.randrange(100, 999)})", lambda r: f"${r.random():.2f}", lambda r: "2024-01-0" + str(r.randrange(1, 9)), lambda r: r.choice(["TRUE", "false"]), lambda r: r.choice(["Net income", "net_x", "ABC", "a|b", "x\ny", "q1:"]), lambda r: "", lambda r: r.choice(["alpha", "beta", "gamma"]), lambda r: f"code {r.randrange(99)}"]


def random_grid(rng):
    wide, tall = rng.randrange(1, 6), rng.randrange(1, 14)
    makers = [rng.choice(VALUES) for _ in range(wide)]
    grid = [[m(rng) if rng.random() < 0.9 else rng.choice(VALUES)(rng) for m in makers] for _ in range(tall)]
    if rng.random() < 0.5:
        grid[0] = [rng.choice(["Amount", "Bank name", "Date", "Amount", "", "ID"]) for _ in makers]
    return grid


def test_regions_against_plain_rules(spark):
    rng = random.Random(6)
    regions, want_tables, want_columns = [], {}, {}
    for i in range(80):
        grid = random_grid(rng)
        first, left = rng.randrange(1, 50), rng.choice([1, 3, 26])
        rows = [{"row_number": first + a, "cells": [{"column_number": left + b, "value": v} for b, v in enumerate(r) if v or rng.random() < 0.5]} for a, r in enumerate(grid)]
        columns = list(range(left, left + len(grid[0])))
        used = sorted({c["column_number"] for r in rows for c in r["cells"]})
        region = {"region_id": f"r{i}", "used_range": f" A{i} ", "rows": rows}
        if rng.random() < 0.5:
            region |= {"column_numbers": [str(9), *columns[::-1]], "row_numbers": [first + a for a in range(len(grid))]}
        else:
            columns = used
        rng.shuffle(rows)
        regions.append((i, json.dumps(region), f"around {i}"))
        if not columns:
            want_tables[i] = (0, 0, "headerless", [])
            continue
        grid = [[r[c - left] for c in columns] for r in grid]
        positions = [letters(c) for c in columns]
        m = mode(grid)
        data = grid if m == "headerless" else grid[1:]
        raw = positions if m == "headerless" else [v.replace("\\|", "|").replace("<br>", "\n") for v in grid[0]]
        at = first + (m != "headerless")
        lines = ["| " + " | ".join([str(at + a), *(v.replace("|", "\\|").replace("\n", "<br>") for v in r)]) + " |" for a, r in enumerate(data)]
        want_tables[i] = (len(data), first if m == "header_row" else 0, m, lines if len(lines) <= 8 else lines[:5] + lines[-3:])
        for b, (p, n) in enumerate(zip(positions, names_of(raw, positions))):
            want_columns[i, b + 1] = (p, n, *profile([r[b] for r in data]))
    tables, columns = ta.analysed(ta.from_regions(spark.createDataFrame(regions, "id long, raw string, around string").repartition(3), ["id"], framing="around"))
    rows = {r.id: r for r in tables.collect()}
    assert {i: (r.row_count, r.header_row, r.header_mode, r.sample_rows) for i, r in rows.items()} == want_tables
    assert all(r.region_id == f"r{i}" and r.used_range == f"A{i}" and r.framing == f"around {i}" and r.token_count == 2 for i, r in rows.items())
    assert_profiles(got_columns(columns), want_columns)


TEXTS = {
    0: "# Sheet\n- Used range: A1:B3\n\n| Row | A | B |\n| --- | :---: | --- |\n| 1 | Name | Amount |\n| 2 | x\\|y | 5 |\n| 3 | a<br>b | 7 |\n\nafter",
    1: "no table here", 2: "| A | B |\n|---|---|", 3: "| A | B |\n|---|---|\n| Name | Name |", 4: "| Row | A | B |\n|---|---|---|\n| x | 1 | 2024-01-01 |\n| 4 | 2 | 2024-01-02 |", 5: "| A | B | C |\n|---|---|---|\n| One |\n| 1 | 2 | 3 | 4 |", 6: None, 7: "",
    8: "| Row | A |\n|---|---|\n| 7 | Head |\ntext between | bars\n| 9 | " + " |\n| 9 | ".join("v" * i for i in range(1, 12)) + " |",
}


def plain_markdown(text):
    text = text or ""
    lines = text.split("\n")
    at = [i for i, x in enumerate(lines) if re.match(r"^\|.+\|$", x.strip())]
    words = max(1, int(len(text.split()) * 1.3))
    if not at:
        return (0, 0, "", text.strip(), words, []), []
    framing = "\n\n".join(x for x in ("\n".join(lines[: at[0]]).strip(), "\n".join(lines[at[-1] + 1 :]).strip()) if x)
    cut = lambda x: [p.strip() for p in re.split(r"(?<!\\)\|", x.strip().removeprefix("|").removesuffix("|"))]
    heads, *below = lines[at[0] : at[-1] + 1]
    below = [x for x in below if not ([c for c in cut(x) if c] and all(re.match("^:?-+:?$", c) for c in cut(x) if c))]
    skip = cut(heads)[0] == "Row"
    positions = cut(heads)[skip:]
    if not below:
        return (0, 0, "", framing, words, []), []
    grid = [[c.replace("\\|", "|").replace("<br>", "\n") for c in cut(x)[skip:]] for x in below]
    grid = [(r + [""] * len(positions))[: len(positions)] for r in grid]
    headed = not is_data(grid[0])
    raw = grid[0] if headed else positions
    own = cut(below[0])[0]
    shown = below[headed:]
    table = (len(shown), int(own) if headed and skip and own.isdigit() else 0, "header_row" if headed else "headerless", framing, words, shown if len(shown) <= 8 else shown[:5] + shown[-3:])
    return table, [(p, n, *profile([r[b] for r in grid[headed:]])) for b, (p, n) in enumerate(zip(positions, names_of(raw, positions)))]


def test_markdown_against_plain_rules(spark):
    rng = random.Random(9)
    texts = dict(TEXTS)
    for i in range(20, 60):
        grid = random_grid(rng)
        cell = lambda v: v.replace("|", "\\|").replace("\n", "<br>")
        rows = ["| " + " | ".join(["Row", *(letters(b + 1) for b in range(len(grid[0])))]) + " |", "| --- " * (len(grid[0]) + 1) + "|", *("| " + " | ".join([str(a + 3), *map(cell, r)]) + " |" for a, r in enumerate(grid))]
        texts[i] = "- Used range: B2:C9\n" + "\n".join(rows) + rng.choice(["", "\n\nVisuals\n"])
    tables, columns = ta.analysed(ta.from_markdown(spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3), ["id"]))
    want = {i: plain_markdown(t) for i, t in texts.items()}
    rows = {r.id: r for r in tables.collect()}
    assert {i: (r.row_count, r.header_row, r.header_mode, r.framing, r.token_count, r.sample_rows) for i, r in rows.items()} == {i: t for i, (t, _) in want.items()}
    assert rows[0].used_range == "A1:B3" and rows[1].used_range == "" and rows[20].used_range == "B2:C9"
    assert_profiles(got_columns(columns), {(i, b + 1): c for i, (_, cs) in want.items() for b, c in enumerate(cs)})


def test_raw_rows_and_what_is_rejected(spark):
    cell = lambda c, v: {"column_number": c, "value": v}
    good = {"rows": [{"row_number": 1, "cells": [cell(1, "a"), cell(2, 5), cell(3, None), cell(4, True), {"column_number": 5}, cell(6, 1.5), 7, cell("1", "x"), cell(1.5, "x"), cell(True, "y")]}, 3, {"row_number": "2", "cells": []}, {"row_number": 2, "cells": {}}, {"row_number": 4}, {"cells": []}, {"row_number": True, "cells": []}]}
    texts = [(1, json.dumps(good)), (2, "[1]"), (3, "{"), (4, '{"rows": 5}'), (5, None), (6, "{}"), (7, '{"rows": []}')]
    cells, rejected = ta.raw_rows(spark.createDataFrame(texts, "id long, raw string"), ["id"])
    assert [(r.row, r.col, r.value) for r in cells.filter("col is not null").orderBy("at", "place").collect()] == [(1, 1, "a"), (1, 2, "5"), (1, 3, ""), (1, 4, "True"), (1, 5, ""), (1, 6, "1.5")]
    assert {r.row for r in cells.collect()} == {1, 4}
    reasons = sorted((r.id, -1 if r["at"] is None else r["at"], -1 if r.place is None else r.place, r.reason) for r in rejected.collect())
    assert reasons == [
        (1, 0, 6, "cell is no object"), (1, 0, 7, "column_number is no integer"), (1, 0, 8, "column_number is no integer"), (1, 0, 9, "column_number is no integer"), (1, 1, -1, "row is no object"), (1, 2, -1, "row_number is no integer"), (1, 3, -1, "cells is no list"),
        (1, 5, -1, "row_number is no integer"), (1, 6, -1, "row_number is no integer"), (2, -1, -1, "no object"), (3, -1, -1, "no JSON"), (4, -1, -1, "rows is no list"), (5, -1, -1, "no JSON"),
    ]


def test_empty(spark):
    none = spark.createDataFrame([], "id long, raw string, text string")
    for t in (ta.from_regions(none, ["id"]), ta.from_markdown(none, ["id"])):
        assert [x.count() for x in ta.analysed(t)] == [0, 0]
    tables, columns = ta.analysed(ta.from_regions(spark.createDataFrame([(1, "{}"), (2, None), (3, '{"rows": [{"row_number": 1, "cells": []}], "column_numbers": [2]}')], "id long, raw string"), ["id"]))
    assert sorted((r.id, r.row_count, r.header_mode) for r in tables.collect()) == [(1, 0, "headerless"), (2, 0, "headerless"), (3, 0, "header_row")]
    assert [(r.id, r.position, r.name, r.dtype) for r in columns.collect()] == [(3, "B", "", "text")]


def test_cells_are_dealt_once(spark):
    """Before, each step shuffled all cells anew, by the table and a row or a place."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        raw = json.dumps({"rows": [{"row_number": i, "cells": [{"column_number": 1, "value": f"v{i}"}]} for i in range(1, 4)]})
        found = ta.analysed(ta.from_regions(spark.createDataFrame([(1, raw), (2, raw)], "id long, raw string"), ["id"]))
        for df in found:
            assert df.count() == 2 and "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_raw_rows_parse_each_text_once(spark):
    """Reasons were conditions of filters, so a text was parsed and a row's kind told again for each of them, and for rejected rows in three branches."""
    raws = ['{"rows":[{"row_number":1,"cells":[{"column_number":2,"value":true},{"column_number":"3","value":1},7,null]},{"row_number":2},{"row_number":3,"cells":null},{"row_number":4,"cells":{}},{"row_number":"5","cells":[]},{"cells":[]},[1],null,{"row_number":6,"cells":[{"column_number":1,"value":{"a":[1]}},{"column_number":2}]}]}', "[]", "{", '{"rows":1}', "{}", '{"rows":null}', '{"rows":[]}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "id int, raw string")
    cells, rejected = ta.raw_rows(df, ["id"])
    assert sorted(((r.at, r.row, r.place, r.col, r.value) for r in cells.collect()), key=str) == sorted([(0, 1, 0, 2, "True"), (0, 1, 1, None, None), (0, 1, 2, None, None), (0, 1, 3, None, None), (1, 2, None, None, None), (8, 6, 0, 1, '{"a":[1]}'), (8, 6, 1, 2, "")], key=str)
    own = [(0, 0, 1, "column_number is no integer"), (0, 0, 2, "cell is no object"), (0, 0, 3, "cell is no object"), (0, 2, None, "cells is no list"), (0, 3, None, "cells is no list"), (0, 4, None, "row_number is no integer"), (0, 5, None, "row_number is no integer"), (0, 6, None, "row is no object"), (0, 7, None, "row is no object")]
    whole = [(1, None, None, "no object"), (2, None, None, "no JSON"), (3, None, None, "rows is no list"), (5, None, None, "rows is no list")]
    assert sorted(map(str, ((r.id, r.at, r.place, r.reason) for r in rejected.collect()))) == sorted(map(str, own + whole))
    for found in (cells, rejected):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_a_table_is_analysed_in_its_row(spark):
    """Before, cells were written six times and joined and sorted by table; rows and cells that occur twice, rows that are only listed, and columns that are only listed count as they did."""
    cell = lambda c, v: {"column_number": c, "value": v}
    rows = [{"row_number": 7, "cells": [cell(2, "lost")]}, {"row_number": 5, "cells": [cell(2, "Name"), cell(4, "x"), cell(2, "Bank"), cell(9, "no column")]}, {"row_number": 7, "cells": [cell(2, "a"), cell(4, " ")]}, {"row_number": 3, "cells": [cell(2, "b"), cell(4, "1")]}]
    regions = [(1, json.dumps({"rows": rows, "column_numbers": [4, 2, 3], "row_numbers": [5, 6, 7]})), (2, json.dumps({"rows": rows}))]
    found = ta.analysed(ta.from_regions(spark.createDataFrame(regions, "id long, raw string"), ["id"]))
    for df in found:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Join", "Exchange", "Window", "scratch_")), plan
    tables, columns = ({r.id: r for r in found[0].collect()}, [r for r in found[1].orderBy("id", "place").collect()])
    assert (tables[1].row_count, tables[1].header_row, tables[1].sample_rows) == (3, 5, ["| 6 |  |  |  |", "| 7 | a |  |   |", "| 3 | b |  | 1 |"])
    assert (tables[2].row_count, tables[2].header_mode, tables[2].sample_rows) == (2, "header_row", ["| 5 | Bank | x | no column |", "| 7 | a |   |  |"])
    assert [(r.id, r.position, r.name, r.dtype, r.non_null_count, r.null_count, r.sample_values) for r in columns] == [
        (1, "B", "Bank", "text", 2, 1, ["a", "b"]), (1, "C", "", "text", 0, 3, []), (1, "D", "x", "numeric", 1, 2, ["1"]),
        (2, "B", "b", "text", 2, 0, ["Bank", "a"]), (2, "D", "1", "text", 1, 1, ["x"]), (2, "I", "", "text", 1, 1, ["no column"]),
    ]
