import random
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import types as T

from spoolmark.operators.rejects import header_lines, read_lines, split_lines

LINES = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("line_no", T.IntegerType()), T.StructField("raw_line", T.StringType()), T.StructField("code", T.StringType()), T.StructField("reason", T.StringType())])
NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[Ee][+-]?[0-9]+)?")


def fields(line):
    """A plain character scan; None for a quoting fault."""
    out, i = [], 0
    while i < len(line):
        if line[i] in " \t":
            i += 1
        elif line[i] == '"':
            value, i = "", i + 1
            while True:
                j = line.find('"', i)
                if j < 0:
                    return None
                value += line[i:j]
                if line[j + 1 : j + 2] == '"':
                    value, i = value + '"', j + 2
                else:
                    i = j + 1
                    break
            if i < len(line) and line[i] not in " \t":
                return None
            out.append(value)
        else:
            j = i
            while j < len(line) and line[j] not in " \t":
                j += 1
            if '"' in line[i:j]:
                return None
            out.append(line[i:j])
            i = j
    return out


def reason(line_no, raw):
    line = raw or ""
    f = fields(line[:-1] if line.endswith("\r") else line)
    number = lambda x: NUMBER.fullmatch(x) and abs(float(x)) < float("inf")
    if f is None:
        return "quoting"
    if line_no is not None and 1 <= line_no <= 10:
        return "column_count" if len(f) != 14 else None if all(re.fullmatch("[+-]?[0-9]+", x) for x in f) else "bad_switch"
    if len(f) != 10:
        return "column_count"
    if not re.fullmatch("[0-9]{1,3}", f[0]) or not int(f[0]):
        return "bad_code"
    if not all(map(number, f[1:7])):
        return "bad_coord"
    if not number(f[7]) or not 0 < float(f[7]) <= 3000:
        return "bad_bore"
    return "bad_tail" if int(f[0]) == 100 and "," not in f[9] else None


def judged(spark, cases):
    d = spark.createDataFrame([(i, n, raw, "clash", "clash") for i, (n, raw) in enumerate(cases)], LINES)
    return d, {r.row_id: r.reason for r in read_lines(d).select("row_id", "reason").collect()}


def test_agrees_with_a_character_scan(spark):
    rng = random.Random(2)
    good = ["100", "1.5", "-2", "+3.", ".4", "5E1", "6e-2", "20", "{A}", '"a, b"']
    odd = ["", "0", "000", "1000", "١", "1_0", "NaN", "inf", "1e999", "0x1", "1f", "3000.1", "3000", "-0", "0.0", '""', '"x', 'y"', '"a""b"', '"a"b', '"a" b"', "x,y", ".", "+", "1.2.3", "１", "\u0001", "\u0000", "a\nb"]
    cases = [(n, x) for n in (None, 5, 11) for x in (None, "", " ", "\t \r", "\r", '"', '""', '"""', '""""', '"" ""', " ".join(["1"] * 14), " ".join(["1"] * 13 + ["x"]), " \t".join(good) + " \r", " ".join(good) + "\r\r")]
    for _ in range(1500):
        f = list(good)
        for _ in range(rng.choice([0, 1, 1, 2])):
            f[rng.randrange(10)] = rng.choice(odd)
        if rng.random() < 0.1:
            f.insert(rng.randrange(10), rng.choice(odd))
        cases.append((rng.choice([11, 11, 400, 3]), rng.choice(["", " "]) + rng.choice([" ", "\t", "  "]).join(f) + rng.choice(["", " ", "\r", "\t\r"])))
    cases.append((20, " ".join(good[:9]) + ' "' + "x," * 200_000 + '"'))
    cases.append((20, '"" ' * 60_000))
    cases.append((20, '"' + '""' * 60_000 + '"'))
    d, got = judged(spark, cases)
    for i, (n, raw) in enumerate(cases):
        assert got[i] == reason(n, raw), (n, raw[:200] if raw else raw)
    fine, bad = split_lines(d)
    assert fine.count() + bad.count() == sum(1 for i, (n, raw) in enumerate(cases) if got[i] or not (n and n <= 10))
    assert fine.where("code is null or ax is null or bore is null or src_code != 'clash'").count() == 0
    kept = read_lines(d).where("geometry.corrupt_raw is not null or switches.corrupt_raw is not null")
    assert kept.where("reason is null").count() == 0


def test_empty_table(spark):
    fine, bad = split_lines(spark.createDataFrame([], LINES))
    assert fine.count() == 0 and bad.count() == 0


def test_every_line_comes_out_once(spark):
    wide = "9" * 20
    cases = [(1, "\t ".join(str(i) for i in range(14))), (10, '"+7" -8 ' + " ".join(["0"] * 12) + "\r"), (2, " ".join([wide] + ["5"] * 13)), (3, "1 2"), (11, '100 1 2 3 4 5 6 20 {A} "a, b"'), (11, "x")]
    d = spark.createDataFrame([(i, n, raw, "c", "r") for i, (n, raw) in enumerate(cases)], LINES)
    heads = {r.row_id: r for r in header_lines(d).collect()}
    assert [heads[0][f"s{i:02d}"] for i in range(14)] == list(range(14)) and heads[0].corrupt_raw is None
    assert [heads[1][f"s{i:02d}"] for i in range(14)] == [7, -8] + [0] * 12
    assert heads[2].s00 is None and heads[2].s13 == 5 and wide in heads[2].corrupt_raw
    fine, bad = split_lines(d)
    assert sorted([*heads, *[r.row_id for r in fine.collect()], *[r.row_id for r in bad.collect()]]) == list(range(6))


def test_separators_inside_quotes_do_not_count(spark):
    inside = "\t".join(["x"] * 25_000)
    cases = [(11, f'100 1 2 3 4 5 6 20 "{inside}" "a, b"'), (11, f'100 1 2 3 4 5 6 20 "{inside}" "a, b" c'), (11, f'100 1 2 3 4 5 6 20 "{inside}"x'), (11, "1\t" * 25_000)]
    d = spark.createDataFrame([(i, n, raw, "c", "r") for i, (n, raw) in enumerate(cases)], LINES)
    fine, bad = split_lines(d)
    assert [(r.code, r.ax, r.bore, r.uci, r.tail) for r in fine.collect()] == [(100, 1.0, 20.0, inside, "a, b")]
    assert {r.row_id: r.reason for r in bad.collect()} == {1: "column_count", 2: "quoting", 3: "column_count"}
