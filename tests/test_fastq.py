import gzip
import random

import pytest

from arborseed.sources import fastq, readers


def made(rng, n, end="\n"):
    rows, text = [], ""
    for i in range(n):
        size = rng.choice([0, 1, 5, 40, 200])
        seq, qual = "".join(rng.choices("ACGTN", k=size)), "".join(rng.choices("@+I!>5", k=size))
        rows.append((f"r{i}", seq, qual))
        text += f"@r{i}{' x y' * (i % 3 == 0)}{end}{seq}{end}+{f'r{i}' * (i % 2)}{end}{qual}{end}"
    return rows, text


def shifted(text, size):
    """Records of the text, split by split, as the partitions find them."""
    data, out = text.encode(), []
    for begin in range(0, len(data), size):
        base = max(0, begin - 1)
        chunks = (data[i : i + 17] for i in range(base, len(data), 17))
        for raw, at, lb, le in fastq.records(chunks, base, begin, min(len(data), begin + size)):
            out += [(int(a), *(bytes(raw[b:e]).decode() for b, e in zip(x, y))) for a, x, y in zip(at, lb, le)]
    return out


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_any_split_finds_each_record_once(end):
    rows, text = made(random.Random(1), 25, end)
    for cut in (0, len(end)):  # with and without the last line's end
        body = text[: len(text) - cut] + "\n\n" * (cut == 0)
        for size in (1, 2, 3, 7, 50, 333, 10_000):
            got = shifted(body, size)
            assert [(x[1].split()[0][1:], x[2], x[4]) for x in got] == rows
            assert [body[x[0]] for x in got] == ["@"] * 25 and [x[0] for x in got] == sorted(x[0] for x in got)


def test_scan_has_no_exchange(spark, tmp_path, capsys):
    rng = random.Random(2)
    rows, text = made(rng, 300)
    more, other = made(rng, 20, "\r\n")
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.fastq").write_text(text)
    with gzip.open(tmp_path / "f" / "b.fastq.gz", "wb") as f:
        f.write(other[:200].encode())
    with gzip.open(tmp_path / "f" / "b.fastq.gz", "ab") as f:  # a second member
        f.write(other[200:].encode())
    (tmp_path / "f" / "_SUCCESS").write_text("")
    (tmp_path / "f" / "c.fastq").write_text("")
    df = fastq.scan(spark, str(tmp_path / "f"), 1000)
    got = sorted(map(tuple, df.select("file", "at", "name", "seq", "qual").collect()))
    assert [x[2:] for x in got] == rows + more
    assert df.rdd.getNumPartitions() == -(-len(text) // 1000) + 1
    df.where("seq <> ''").explain()
    assert "Exchange" not in capsys.readouterr().out
    assert fastq.scan(spark, f"file://{tmp_path}/f/a*").count() == 300


def test_faults_are_errors(spark, tmp_path):
    for text in ("@r\nAC\n+\nI\n", "@r\nAC\n", "x\n", "@r\nAC\n+\nII\nr2\nA\n+\nI\n", "@r\nA\n+\nI\n\n@r\nA\n+\nI\n"):
        (tmp_path / "x.fq").write_text(text)
        with pytest.raises(Exception, match="FASTQ"):
            fastq.scan(spark, str(tmp_path / "x.fq")).collect()
    (tmp_path / "x.fq").write_text("")
    assert fastq.scan(spark, str(tmp_path / "x.fq")).count() == 0
    with pytest.raises(Exception, match="nothing"):
        fastq.scan(spark, str(tmp_path / "nothing")).collect()


def test_numbered_reads(spark, tmp_path):
    rows, text = made(random.Random(3), 100)
    (tmp_path / "a.fq").write_text(text)
    got = readers.reads(spark, str(tmp_path / "a.fq"), split_bytes=700)
    assert sorted(map(tuple, got.collect())) == [(i, *r) for i, r in enumerate(rows)]


def test_tasks_grow_with_the_bytes_and_not_with_the_splits(tmp_path):
    rows, text = made(random.Random(5), 300)
    (tmp_path / "a.fastq").write_text(text)
    reader = fastq.FastqReader({"path": str(tmp_path / "a.fastq"), "splitbytes": "50", "taskbytes": "1000000"})
    parts = reader.partitions()
    assert len(parts) == 1 and parts[0].step == 50
    found = [r for p in parts for batch in reader.read(p) for r in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
    assert found == rows


def test_a_small_split_reads_little_of_a_large_file(tmp_path, monkeypatch):
    (tmp_path / "a.fastq").write_text("@r\nACGT\n+\nIIII\n" * 100_000)
    read, plain = [], fastq.plain_bytes
    monkeypatch.setattr(fastq, "plain_bytes", lambda *a: (read.append(len(x)) or x for x in plain(*a)))
    reader = fastq.FastqReader({"path": str(tmp_path / "a.fastq")})
    assert sum(len(b) for b in reader.split(fastq.Split(str(tmp_path / "a.fastq"), 150_000, 160_000))) in (666, 667)
    assert sum(read) < 100_000
