"""Records of JSON documents that are cut into blocks anywhere."""

import json
import random

import pytest

from tessera.sources import json_records as J


def documents(tmp_path):
    rng = random.Random(8)
    words = ['"', "\\", "{", "}", "[", "]", ":", ",", "\n", "é", "a", "\\\\\"", " ", "locations"]
    value = lambda d: rng.choice([1, None, "".join(rng.choice(words) for _ in range(rng.randint(0, 9))), [1, [2]], {"a": "]"} if d else {}])
    record = lambda: {"id": rng.randint(0, 99), "t": value(1), "locations": [{"no": value(0)}], "u": {"x": [{"y": value(1)}]}}
    out = {
        "named.json": {"source": 'a "[{" b\\', "other": [{"no": 1}], "locations": [record() for _ in range(40)], "later": [{"no": [{}]}]},
        "top.json": [record() for _ in range(30)],
        "empty.json": {"locations": [], "z": [{"no": 1}]},
        "none.json": {"source": "x"},
        "one.json": {"locations": [{"t": "x" * 3000 + '\\"}]'}]},
    }
    for k, (name, doc) in enumerate(out.items()):
        (tmp_path / name).write_text(json.dumps(doc, indent=[None, 2][k % 2], ensure_ascii=k == 0))
    return out


@pytest.mark.parametrize("block", [23, 64, 1000, 1 << 20])
def test_every_cut_gives_the_same_records(spark, tmp_path, block):
    docs = documents(tmp_path)
    for name in ("locations", ""):
        got = J.read_records(spark, str(tmp_path), name, block).collect()
        want = sorted((d, k, json.dumps(r)) for d, doc in docs.items() for k, r in enumerate(doc.get(name, []) if isinstance(doc, dict) else doc if not name else []))
        assert sorted((r.document, r.position, json.dumps(json.loads(r.record))) for r in got) == want
        for r in got:
            assert (tmp_path / r.document).read_bytes()[r.start :].startswith(r.record.encode())


def test_one_document_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"locations": [{"id": k} for k in range(500)]}))
    out = J.read_records(spark, str(tmp_path / "d.json"), "locations", 500)
    assert out.rdd.getNumPartitions() > 5
    assert sorted((r.position, r.id) for r in J.parsed(out, "id long").collect()) == [(k, k) for k in range(500)]


def test_a_cut_off_document_is_an_error(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"locations": [{"id": 1}, {"id": ')
    with pytest.raises(Exception, match="within a record"):
        J.read_records(spark, str(tmp_path), "locations").collect()


def test_ends_of_records_come_with_their_places(tmp_path):
    text = b'[{"a": {"b": "}"}}, {"c": [{}]}, {"d": 1}]'
    (tmp_path / "x.json").write_bytes(text)
    starts, stops, raw = J.record_spans(str(tmp_path / "x.json"), 0, len(text) - 3, False, 0, 0, 1)
    assert [raw[i:j] if j else None for i, j in zip(starts.tolist(), stops.tolist(), strict=True)] == [b'{"a": {"b": "}"}}', b'{"c": [{}]}', None]
