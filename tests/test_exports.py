"""Exports written to folders and read back."""

import csv
import io
import json

from quire.plans.views import Views
from quire.sources.export import CSV_COLUMNS, link_rows, write_csv, write_json

FOLDER = "/root/testdata/sf0.001"


def test_csv_files(spark, tmp_path):
    """A file a user: heads, then the links in order; every cell comes back, but for the mark before what looks like a formula."""
    v = Views(spark, FOLDER)
    write_csv(v, str(tmp_path / "csv"))
    want = {}
    for r in sorted(link_rows(v).collect(), key=lambda r: (r.user_id, r.place)):
        want.setdefault(r.user_id, []).append(["" if r[c] is None else str(r[c]).lower() if isinstance(r[c], bool) else str(r[c]) for c in CSV_COLUMNS.values()])
    folders = list((tmp_path / "csv").glob("user_id=*"))
    assert {int(f.name.split("=")[1]) for f in folders} == set(want)
    for folder in folders:
        (file,) = folder.glob("part-*")
        text = file.read_bytes().decode()
        assert text.endswith("\r\n")
        heads, *rows = csv.reader(io.StringIO(text, newline=""))
        plain = [[c[1:] if c[:2] in ("'=", "'+", "'-", "'@") else c for c in row] for row in rows]
        assert heads == list(CSV_COLUMNS) and plain == want[int(folder.name.split("=")[1])]


def test_json_files(spark, tmp_path):
    v = Views(spark, FOLDER)
    write_json(v, str(tmp_path / "json"))
    got = sorted((json.loads(x) for f in (tmp_path / "json").glob("user_id=*/*.json") for x in f.read_text().splitlines()), key=lambda r: r["link_id"])
    want = [{k: x for k, x in r.asDict().items() if k != "user_id" and x is not None} for r in link_rows(v).orderBy("link_id").collect()]
    assert got == want
