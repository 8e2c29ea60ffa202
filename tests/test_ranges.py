"""Files cut at any byte give the same rows."""

import random

import pytest

from cladeweave.sources import ranges

TEXTS = [
    ">a one\nAC\nGT\n>b\n\nTT\r\n>c",
    "",
    "stray\n>x\nAC>GT\n",
    "\n\n>only\nA",
    ">\n>e\n\n\n>f\nAAAA",
    ">ü\nAC\n" * 5,
    "no records\nat all\n",
]


def plain(text):
    out, at = [], 0
    for line in text.encode().splitlines(keepends=True):
        if line.startswith(b">"):
            out.append([at, line[1:].decode().strip(), ""])
        elif out:
            out[-1][2] += "".join(line.decode().split())
        at += len(line)
    return [tuple(x) for x in out]


@pytest.mark.parametrize("chunk", [1, 3, 7, 1 << 20])
def test_records_of_all_ranges(tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(ranges, "CHUNK", chunk)
    for k, text in enumerate(TEXTS):
        file, size = tmp_path / f"{k}.fa", len(text.encode())
        file.write_bytes(text.encode())
        for step in range(1, size + 2):
            reader = ranges._FastaReader({"path": str(file), "range_bytes": step})
            got = [row[1:] for part in reader.partitions() for row in reader.rows(part)]
            assert got == plain(text), (text, step)


def test_sources_in_a_session(spark, tmp_path):
    rng = random.Random(1)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    texts = {f"MARKER_m{k}.fasta": t for k, t in enumerate(TEXTS)}
    texts["deep/long.fasta"] = "".join(f">s{k}\n" + "\n".join("ACGT" * rng.randrange(9) for _ in range(rng.randrange(4))) + "\n" for k in range(300))
    for name, text in texts.items():
        (tmp_path / "in" / name).write_bytes(text.encode())
    for size in (5, 999, 1 << 20):
        got = sorted((r.file.split("/in/")[1], r.at, r.name, r.seq) for r in ranges.read_fasta_ranges(spark, f"{tmp_path}/in", size).collect())
        assert got == sorted((f, *x) for f, t in texts.items() for x in plain(t))
    status = {r.file.rsplit("/", 1)[1]: (r.n_records, r.status) for r in ranges.fasta_file_status(spark, f"{tmp_path}/in", 50).collect()}
    assert status == {
        "MARKER_m0.fasta": (3, "OK"), "MARKER_m1.fasta": (0, "EMPTY"), "MARKER_m2.fasta": (0, "NOT_FASTA"), "MARKER_m3.fasta": (1, "OK"),
        "MARKER_m4.fasta": (3, "OK"), "MARKER_m5.fasta": (5, "OK"), "MARKER_m6.fasta": (0, "NOT_FASTA"), "long.fasta": (300, "OK"),
    }
    assert {r.marker for r in ranges.read_fasta_ranges(spark, f"file://{tmp_path}/in/MARKER_m0.fasta").collect()} == {"m0"}
    with pytest.raises(Exception, match="nowhere"):
        ranges.read_fasta_ranges(spark, f"{tmp_path}/nowhere").collect()


def test_tree_lines_of_all_ranges(spark, tmp_path):
    text = "#NEXUS\nBEGIN TREES;\n tree one = [&R] (a,(b,c));\nUTREE two = (a,b,c);\nEND;\n(x,y);\n"
    (tmp_path / "t.nex").write_text(text)
    for size in (1, 13, 1000):
        got = ranges.read_tree_ranges(spark, str(tmp_path), size).collect()
        assert sorted((r.tree_id, r.newick) for r in got) == [("t.nex:20", "(a,(b,c));"), ("t.nex:48", "(a,b,c);"), ("t.nex:74", "(x,y);")]
