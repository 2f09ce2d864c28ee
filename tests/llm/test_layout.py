import pyarrow as pa

from changeweave.llm.layout import bounded, joined, pieces

BOX = pa.list_(pa.struct([(n, pa.int32()) for n in ("x0", "y0", "x1", "y1", "conf")]))


def read(text, boxes):
    p = pieces(pa.array([text], pa.string()), pa.array([boxes], BOX))
    out = {}
    for flow in (0, 1):
        out[flow] = "".join(joined(p, p.flow == flow)[0].to_pylist()).strip()
    return out


def box(x, y, text):
    return {"x0": x, "y0": y, "x1": x + round(10.85 * len(text)), "y1": y + 20, "conf": 80}


def test_columns_are_read_one_after_the_other():
    lines = [("first col-", 50, 100), ("second", 500, 101), ("umn text", 52, 126), ("column", 498, 127)]
    assert read("\n".join(t for t, *_ in lines), [box(x, y, t) for t, x, y in lines])[0] == "first column text second column"


def test_lines_read_across_are_cut():
    rows = [("left one two three four", "right one two three four"), ("left five six seven eight", "right five six seven eight")]
    text = "\n".join("   ".join(r) for r in rows)
    boxes = [{"x0": 50, "y0": 100 + 25 * i, "x1": 500 + round(10.85 * len(b)), "y1": 120 + 25 * i, "conf": 1} for i, (_, b) in enumerate(rows)]
    assert read(text, boxes)[0] == "left one two three four left five six seven eight right one two three four right five six seven eight"


def test_indented_lines_flow_apart():
    lines = [("article goes", 50, 100), ("ADVERT here", 80, 125), ("on below", 51, 150)]
    assert read("\n".join(t for t, *_ in lines), [box(x, y, t) for t, x, y in lines]) == {0: "article goes on below", 1: "ADVERT here"}


def test_missing_boxes_and_texts():
    assert read("a\nb", None)[0] == "a b"
    assert read("a\nb", [box(10, 5, "a")])[0] == "a b"
    assert read(None, None) == {0: "", 1: ""}
    assert read("", [])[0] == ""
    assert read("a   b\nc", None) == {0: "a b c", 1: ""}
    assert read("one\r\ntwo\rthree", None)[0] == "one two three"


def test_batches_are_bounded():
    batch = pa.record_batch({"text": pa.array(["a" * 5, None, "b" * 30, "", "c" * 2, "d" * 9]), "n": pa.array(range(6))})
    parts = list(bounded(iter([batch, batch.slice(0, 0)]), limit=10))
    assert [p.column("n").to_pylist() for p in parts if p.num_rows] == [[0, 1, 2], [3, 4], [5]] or sum((p.column("n").to_pylist() for p in parts), []) == list(range(6))
    assert max(p.column("text").nbytes for p in parts) < 200
