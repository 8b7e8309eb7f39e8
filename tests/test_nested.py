import json

from hypothesis import given, settings, strategies as st
from pyspark.sql import types as T

from spoolmark.operators.nested import Index, flatten_pages, page_items

values = st.recursive(
    st.none() | st.booleans() | st.integers(-9, 99) | st.floats(allow_nan=False, allow_infinity=False) | st.text('a{"[,\\:\né主', max_size=4),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.sampled_from(["kind", "pipes", "a{", 'q"', "handle", "support", "weld"]), inner, max_size=3),
    max_leaves=12,
)


def strict(text):
    def refuse(_):
        raise ValueError

    try:
        json.loads(text, parse_constant=refuse)
        return True
    except (ValueError, RecursionError):
        return False


def loads_items(text):
    """Plain recursive version."""
    if not text or not strict(text):
        return []
    page = json.loads(text)
    if not isinstance(page, dict):
        return []
    listed = lambda o, k: [(i, e) for i, e in enumerate(o[k]) if e is not None] if isinstance(o, dict) and isinstance(o.get(k), list) else []
    text_of = lambda o, k: o[k] if isinstance(o, dict) and isinstance(o.get(k), str) else str(o[k]) if isinstance(o, dict) and type(o.get(k)) is int else ""
    rows = []
    for i, p in listed(page, "pipes"):
        own = f"P{i:03d}"
        rows.append(("pipe", own, "", text_of(p, "kind")))
        for j, e in listed(p, "endpoint_annotations"):
            f = [isinstance(e, dict) and e.get(k) is True for k in ("support", "weld")]
            rows.append(("endpoint_annotation", f"{own}:E{j}", own, "both" if all(f) else "support" if f[0] else "weld" if f[1] else "empty"))
        rows += [("source_vector_segment", f"{own}:V{j}", own, text_of(e, "handle")) for j, e in listed(p, "source_vector_segments")]
    rows += [("component", f"C{i:03d}", "", text_of(c, "kind")) for i, c in listed(page, "components")]
    return rows


@settings(max_examples=400, deadline=None)
@given(values, st.sampled_from([None, 0, 1]), st.data())
def test_validity_agrees_with_a_parser(value, indent, data):
    text = json.dumps(value, indent=indent, ensure_ascii=data.draw(st.booleans()))
    index = Index(text.encode())
    assert index.ok
    if text:
        at = data.draw(st.integers(0, len(text) - 1))
        broken = data.draw(st.sampled_from([text[:at], text[:at] + text[at + 1 :], text[:at] + data.draw(st.sampled_from(list('{}[]:,"\\1n '))) + text[at:]]))
        assert bool(Index(broken.encode()).ok) == strict(broken), broken


names = st.sampled_from(["elbow", 'q"t', "a\\b", "主管", "[x]", 7, None])
leaf = st.one_of(st.none(), st.fixed_dictionaries({}, optional={"support": st.sampled_from([True, False, None]), "weld": st.sampled_from([True, False, None]), "handle": names, "kind": names, "endpoints": st.just([[1.5, 2], []])}))
pipe = st.one_of(st.none(), st.just("text"), st.fixed_dictionaries({}, optional={"kind": names, "endpoint_annotations": st.one_of(st.none(), st.lists(leaf, max_size=3)), "source_vector_segments": st.one_of(st.just({}), st.lists(leaf, max_size=3)), "pipes": st.just([{}])}))
page = st.fixed_dictionaries({}, optional={"pipes": st.one_of(st.none(), st.lists(pipe, max_size=4)), "components": st.lists(leaf, max_size=4), "export": st.just({"pipes": [{"kind": "no"}], "components": [[]]}), "title": st.just("pipes: [{")})


@settings(max_examples=300, deadline=None)
@given(page, st.sampled_from([None, 2]), st.booleans())
def test_items_agree_with_a_recursive_walk(value, indent, ascii_only):
    text = json.dumps(value, indent=indent, ensure_ascii=ascii_only)
    assert sorted(page_items(text)) == sorted(loads_items(text))


def test_odd_texts():
    for text in (None, "", "  ", "null", "[1]", '{"pipes": [}', '{"pipes": []} x', '{"pipes": [1,]}', "{'a': 1}", '{"a": 01}', '{"a": NaN}', '{"a" 1}', '{,}'):
        assert page_items(text) == []
    assert page_items('{"pipes": [{"kind": "a"}], "pipes": [{"kind": "b"}]}') == [("pipe", "P000", "", "b")]
    assert page_items('{"p\\u0069pes": [{"kind": "b"}]}') == [("pipe", "P000", "", "b")]
    many = json.dumps({"pipes": [{"kind": "k", "title": "x" * 1000}] * 1200})
    assert page_items(many)[-1] == ("pipe", "P1199", "", "k")
    assert page_items('{"a":' + "[" * 3000 + "]" * 3000 + ', "pipes": [{}]}') == [("pipe", "P000", "", "")]


def test_table_with_clashing_columns_and_repeats(spark):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("page_json", T.StringType()), T.StructField("val", T.StringType())])
    rows = [(1, '{"components": [null, {"kind": "tee"}]}', "x")] * 2 + [(2, None, "y"), (None, '{"pipes": [{}]}', None)]
    got = sorted(map(tuple, flatten_pages(spark.createDataFrame(rows, schema), "page_id", "page_json").collect()), key=str)
    assert got == [(1, "component", "C001", "", "tee"), (None, "pipe", "P000", "", "")]
    assert flatten_pages(spark.createDataFrame([], schema), "page_id", "page_json").count() == 0
