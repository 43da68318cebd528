import json

from attestry.operators import grounding as gr


def test_shapes_of_evidence(spark):
    long = "word " * 200
    bodies = {
        1: {"evidence": "a  quote\n here", "pdf_page": 3, "subject": " s  t ", "raw_value": 5},
        2: {"evidence": {"text": "q", "pdf_page": [4, 5]}, "pdf_page": 9},
        3: {"evidence": {"text": ["a", 1, None, True, {"x": 1}, 2.5], "pdf_page": 0}, "pdf_page": "7"},
        4: {"evidence": {"text": {"x": 1}, "pdf_page": []}, "pdf_page": [], "period": None},
        5: {"evidence": ["not", "used"]},
        6: {"evidence": {"pdf_page": "3.5"}},
        7: {"evidence": {"text": long, "pdf_page": 2.9}, "subject": long, "requested_status": "verified"},
        8: {"subject": "no evidence"},
        9: {"evidence": {"text": "t", "pdf_page": True}, "unit": ["a b", "c"], "scope": {"x": 1}},
        10: {"evidence": None},
    }
    rows = [(i, 1, json.dumps(b)) for i, b in bodies.items()] + [(20, 1, "no json {"), (21, 1, None), (22, 1, "[1]"), (23, 1, '"text"')]
    found = {r.item_id: r for r in gr.model_items(spark.createDataFrame(rows, "item_id int, document_id int, body string")).collect()}
    assert sorted(found) == [1, 2, 3, 4, 6, 7, 9]
    assert {i: (r.quote, r.page) for i, r in found.items() if i != 7} == {1: ("a quote here", 3), 2: ("q", 4), 3: ("a; 1; True; 2.5", 7), 4: ("", None), 6: ("", None), 9: ("t", 1)}
    assert (found[1].subject, found[1].raw_value, found[1].unit, found[4].period) == ("s t", "5", None, None)
    assert (found[9].unit, found[9].scope, found[7].requested_status, found[7].page) == ("a b; c", "", "verified", 2)
    assert len(found[7].quote) == 500 and len(found[7].subject) == 240


def test_boxes_of_blocks_then_of_words(spark):
    blocks = [(1, 1, 0, 900, 10, 10, 50, 20), (1, 2, 902, 2950, 5, 30, 70, 40), (1, 3, 2950, 2950, 0, 0, 99, 99), (1, 4, 3000, 9000, None, None, None, None)]
    words = [(1, "Alpha", 1, 1, 2, 2), (1, "beta", 7, 7, 9, 9), (1, "late", 50, 50, 60, 60), (2, "alpha", 0, 0, 1, 1)]
    first12 = "beta " + " ".join(f"w{i}" for i in range(11))
    spans = [(1, 1, 890, 910, "x"), (2, 1, 900, 902, "alpha  beta"), (3, 1, 1000, 2500, "Page 12"), (4, 1, 9000, 9100, first12 + " late"), (5, 1, 9000, 9100, "nothing"), (6, 1, 4000, 5000, "alpha"), (7, 3, 0, 10, None), (8, 1, 0, 9000, "y" * 1200 + " 7")]
    sides = "x0 int, top int, x1 int, bottom int"
    found = gr.evidence_boxes(spark.createDataFrame(spans, "span_id int, page_id int, start int, end int, text string"), spark.createDataFrame(blocks, f"page_id int, block_id int, start int, end int, {sides}"), spark.createDataFrame(words, f"page_id int, word string, {sides}"))
    rows = {r.span_id: r for r in found.collect()}
    box = lambda r: (r.x0, r.top, r.x1, r.bottom)
    assert {i: (r.n_blocks, box(r), r.precision) for i, r in rows.items()} == {
        1: (2, (5, 10, 70, 40), "word-region"),
        2: (0, (1, 1, 9, 9), "word-region"),
        3: (1, (5, 30, 70, 40), "word-region"),
        4: (0, (7, 7, 9, 9), "word-region"),
        5: (0, (None,) * 4, "page-only"),
        6: (1, (1, 1, 2, 2), "word-region"),
        7: (0, (None,) * 4, "page-only"),
        8: (3, (5, 10, 70, 40), "word-region"),
    }
    assert rows[3].printed_page == "12" and rows[8].printed_page == "7" and len(rows[8].excerpt) == 1000 and rows[7].excerpt == "" and rows[2].excerpt == "alpha beta"
