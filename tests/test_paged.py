"""The paged source: the same pages as of whole files, tasks by size, bounded memory."""

import glob
import io
import random
import tracemalloc

from pyarrow import fs

from cartulary import catalogue_runs, storage
from cartulary.sources import files, lines, paged


def test_pages_of_blocks_of_any_size():
    rng = random.Random(3)
    for _ in range(50):
        text = "".join(rng.choice(["a", "é", "😀", "\f", "\n", "word "]) for _ in range(rng.randrange(60)))
        for block in (1, 2, 3, 7, 1000):
            assert list(paged.text_pages(io.BytesIO(text.encode()), block)) == text.split("\f")


def test_same_rows_as_of_whole_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "a.txt").write_text("one\ftwo\f\fé" * 50)
    (tmp_path / "b.HTML").write_text("<p>x</p><script>y</script>")
    (tmp_path / "sub" / "c.md").write_bytes(b"good page\f" + b"x" * 3000 + b"\xff\xfe")
    (tmp_path / "sub" / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "f.exe").write_text("no")
    (tmp_path / "_hidden" / "g.txt").write_text("no")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    columns = ["path", "page_no", "page_count", "content", "error_message", "backend"]
    shown = lambda df: sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    # positions of a wrong byte are told by block, so only the kind of that error is compared
    plain = lambda rows: [(*r[:4], r[4] and r[4].split(":")[0], r[5]) for r in rows]
    every = paged.pages(spark, str(tmp_path), task=100, block=64)
    # Spark passes over files without a byte; here they are documents without text
    got, empty = every.where("NOT endswith(path, 'e.csv')"), every.where("endswith(path, 'e.csv')")
    assert [r["content"] for r in empty.collect()] == [""] and files.loaded(empty).first()["error_code"] == files.LOAD_FAILED
    assert plain(shown(got)) == plain(shown(files.pages(raw)))
    assert every.rdd.getNumPartitions() >= 3
    loaded = lambda read: sorted((r["path"], r["content"], r["page_count"], r["error_code"]) for r in files.loaded(read).collect())
    assert loaded(got) == loaded(files.pages(raw))


def test_files_are_dealt_by_size():
    sizes = [("a", 50), ("b", 500), ("c", 40), ("d", 20), ("e", 5)]
    assert paged.dealt(sizes, 100) == [["b"], ["a", "c"], ["d", "e"]] and paged.dealt([], 100) == []


def test_a_large_file_in_bounded_memory(tmp_path):
    path = tmp_path / "large.txt"
    with open(path, "w") as f:
        for i in range(60_000):
            f.write(f"{i} " + "x" * 1000 + "\f")
    reader = paged.PageReader(str(tmp_path), paged.TASK, paged.BLOCK)
    tracemalloc.start()
    rows = sum(1 for _ in reader.of_file(fs.LocalFileSystem(), str(path)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 60_001 and peak < 12_000_000


def test_an_empty_folder(spark, tmp_path):
    assert paged.pages(spark, str(tmp_path)).count() == 0


def test_ranges_have_each_page_once(tmp_path):
    rng, system = random.Random(5), fs.LocalFileSystem()
    for k in range(40):
        pieces = ["".join(rng.choice(["a", "é", "😀", "\f", "\n", "word "]) for _ in range(rng.randrange(30))).encode() for _ in range(3)]
        named = [(str(tmp_path / f"{k}-{i}.txt"), len(p)) for i, p in enumerate(pieces)]
        for (name, _), p in zip(named, pieces, strict=True):
            with open(name, "wb") as f:
                f.write(p)
        data, task = b"".join(pieces), rng.randrange(1, 20)
        cuts = [*range(0, max(len(data), 1), task)]
        for block in (1, 7, 1000):
            read = lambda at, b=block: paged.blocks(system, named, at, b)
            assert [p for a in cuts for p in paged.range_pages(read, a, a + task if a != cuts[-1] else None)] == data.split(b"\f")


def test_no_task_reads_a_large_text_alone(spark, tmp_path):
    words = [f"word {i} é" * (i % 9) for i in range(300)]
    (tmp_path / "large.txt").write_text("\f".join(words))
    parts = paged.PageReader(str(tmp_path), 500, 64).partitions()
    assert len(parts) > 10 and all(end is None or end - start <= 500 for p in parts for _, start, end in p.ranges) and not any(p.paths for p in parts)
    rows = sorted(tuple(r) for r in paged.pages(spark, str(tmp_path), 500, 64).select("page_no", "page_count", "content", "error_message").collect())
    assert rows == [(i, 300, w, None) for i, w in enumerate(words, 1)]


def test_pieces_are_one_text(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, text in (("1.txt", "one\ftwo,"), ("2.txt", " still two"), ("3.txt", "\fthree\f")):
        (tmp_path / "a" / name).write_text(text)
    (tmp_path / "a" / "_SUCCESS.txt").write_text("no")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "1.txt").write_bytes(b"good\f" + b"x" * 40 + b"\fbad \xff\f")
    (tmp_path / "b" / "2.txt").write_text("good")
    for task in (3, 10, 1000):
        rows = sorted((r["path"][-2:], r["page_no"], r["page_count"], r["content"], r["error_message"] and r["error_message"].split(":")[0]) for r in paged.pages(spark, str(tmp_path), task, 4, pieces=True).collect())
        assert rows == [("/a", i, 4, p, None) for i, p in enumerate(["one", "two, still two", "three", ""], 1)] + [("/b", 1, 1, None, "UnicodeDecodeError")]


def test_a_languages_text_is_written_by_many_tasks(spark, tmp_path):
    rows = [(i, "\n" * (i % 3) + "text\f" * (i % 50), ["en", None][i % 5 == 0], "s", 0) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    folders = lambda kind: set(glob.glob(f"{storage.shared_folder(spark).removeprefix('file://')}/{kind}-*"))
    had = folders("paged")
    got = {r["part"]: tuple(r)[1:] for r in catalogue_runs.q66_paged_files(spark, str(tmp_path)).collect()}
    of = lambda part: [x[1] for x in rows if (x[2] or "none") == part]
    assert got == {p: (len(of(p)) + 1, sum(len(t) + 1 for t in of(p)), max(map(len, of(p)))) for p in ("en", "none")}
    (new,) = folders("paged") - had
    assert len(glob.glob(f"{new}/part=en/*.txt")) > 1


def test_lines_are_numbered_through_pieces(spark, tmp_path):
    for part in ("a", "b"):
        (tmp_path / part).mkdir()
        for k in range(3):
            (tmp_path / part / f"{k}.txt").write_text("".join(f"{part}{5 * k + i}\n" for i in range(5)))
    rows = sorted((r["file"].split("/")[-2], r["line"], r["raw"]) for r in lines.numbered(spark, f"{tmp_path}/*", pieces=True).collect())
    assert rows == sorted((p, i, f"{p}{i}") for p in "ab" for i in range(15))
