import os

from mnemo.operators.store import DocumentStore
from mnemo.sources.folders import FolderReader, ingest_folder, read_folders, run_summary
from mnemo.sources.shared import new_path


def tree(root):
    def put(name, data):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)

    put("a.txt", b"alpha text")
    put("sub/b.TXT", b"beta text")
    put("sub/copy.txt", b"alpha text")
    put("sub/empty.txt", b"")
    put("sub/blank.txt", b"  ")
    put("sub/big.txt", b"x" * 5000)
    put("sub/raw.txt", b"\xff\xfe\x00")
    put("sub/other.pdf", b"pdf")
    put("Archive/hidden.txt", b"never")
    put("sub/archive/deep/hidden.txt", b"never")
    put("archived/seen.txt", b"seen")
    (root / "nothing").mkdir()
    return str(root)


def test_excluded_folders_are_never_listed(spark, tmp_path, monkeypatch):
    root = tree(tmp_path)
    seen = []
    scan = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: (seen.append(str(p)), scan(p))[1])
    parts = FolderReader({"path": root, "excluded": "ARCHIVE"}).partitions()
    assert sorted(os.path.relpath(p.path, root) for p in parts) == [".", "archived", "nothing", "sub"]
    assert not [p for p in seen if os.path.basename(p).lower() == "archive" or "deep" in p]
    monkeypatch.undo()
    rows = read_folders(spark, root, "*.txt", ["archive"], 1000).collect()
    got = {os.path.relpath(r["path"], root): (r["status"], r["length"]) for r in rows}
    assert got == {"a.txt": ("ok", 10), "sub/b.TXT": ("ok", 9), "sub/copy.txt": ("ok", 10), "sub/empty.txt": ("skipped_empty", 0), "sub/blank.txt": ("ok", 2), "sub/big.txt": ("skipped_oversize", 5000), "sub/raw.txt": ("ok", 3), "archived/seen.txt": ("ok", 4)}
    bare = read_folders(spark, root, "*.txt", ["archive"], 1000, contents=False)
    assert bare.where("content is not null").count() == 0 and bare.where("content_hash is not null").count() == 6
    assert read_folders(spark, str(tmp_path / "nothing")).count() == 0


def test_a_folder_is_ingested_once(spark, tmp_path):
    files = read_folders(spark, tree(tmp_path), "*.txt", ["archive"], 1000)
    stored = DocumentStore(spark, new_path(spark, "d"), 4)
    count = lambda told: {r["status"]: r["files"] for r in run_summary(told).collect()}
    skipped = {"skipped_empty": 2, "skipped_oversize": 1, "skipped_unreadable": 1}
    assert count(ingest_folder(files, stored, "0", dry_run=True)) == skipped | {"dry_run": 3, "skipped": 1} and stored.documents().count() == 0
    assert count(ingest_folder(files, stored, "1")) == skipped | {"ingested": 3, "skipped": 1}
    assert {r["title"]: r["metadata"]["domain"] for r in stored.documents().collect()}.keys() == {"a.txt", "b.TXT", "seen.txt"}
    assert count(ingest_folder(files, stored, "2")) == skipped | {"skipped": 4} and stored.chunks().count() == 3
