"""Graph catalog: one JSON manifest per graph, versioned snapshot folders, all through the Hadoop file API."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

MARKER = "_EDGELOOM_SNAPSHOT"
MANIFEST, CLAIM, SNAPSHOT = r"manifest-(\d+)\.json", r"claimed-(\d+)", r"snapshot_id=(\d+)"
FORMAT_VERSION = 1
#: Manifests kept of a graph, the newest counts.
KEPT = 3
MANIFEST_FIELDS = (
    "graph", "edge_table", "src_col", "dst_col", "op_col", "weight_col", "ver_col", "ver_margin", "directed", "active_snapshot",
    "active_max_ver", "delta_from", "node_count", "edge_count", "built_at", "build_seconds", "format_version", "build_memory_mb", "both_directions", "schedule",
)


def check_graph_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_]{1,64}", name or ""):
        raise ValueError(f"graph name {name!r} is not valid: 1 to 64 letters, digits or underscores")
    return name


class Catalog:
    """Commit point of every change is the rename of a finished manifest to a new, higher number; no file is ever replaced, so a
    driver lost at any moment leaves the manifest before it in force.  Snapshots are immutable."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def _read(self, path: str) -> str | None:
        p, fs = self._path(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _write(self, path: str, text: str) -> bool:
        """Writes a file that did not exist before; False if another writer was first."""
        new, fs = self._path(f"{path}.{uuid.uuid4().hex}.new")
        stream = fs.create(new, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        at, _ = self._path(path)
        if not fs.exists(at) and self._rename(fs, new, at):
            return True
        fs.delete(new, False)
        return False

    @staticmethod
    def _rename(fs, new, at) -> bool:
        return fs.rename(new, at)

    def _numbered(self, graph: str, pattern: str) -> list[int]:
        """Numbers in the names of a graph's files that match, in order."""
        p, fs = self._path(f"{self.root}/{check_graph_name(graph)}")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(m[1]) for m in (re.fullmatch(pattern, n) for n in names) if m)

    def manifest(self, graph: str) -> dict | None:
        numbers = self._numbered(graph, MANIFEST)
        text = self._read(f"{self.root}/{graph}/manifest-{numbers[-1]}.json") if numbers else None
        return json.loads(text) if text else None

    def put(self, row: dict) -> None:
        graph = row["graph"]
        numbers = self._numbered(graph, MANIFEST)
        n = numbers[-1] + 1 if numbers else 1
        if not self._write(f"{self.root}/{graph}/manifest-{n}.json", json.dumps(row, indent=1, sort_keys=True)):
            raise OSError(f"manifest {n} of {graph} was written by another process")
        for old in numbers[: 1 - KEPT]:
            p, fs = self._path(f"{self.root}/{graph}/manifest-{old}.json")
            fs.delete(p, False)

    def graphs(self) -> list[str]:
        p, fs = self._path(self.root)
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())

    def next_snapshot_id(self, graph: str) -> int:
        """Never reused, also not after an aborted refresh: an id is claimed by a file of its own."""
        while True:
            n = max([0, *self._numbered(graph, CLAIM), *self._numbered(graph, SNAPSHOT)]) + 1
            if self._write(f"{self.root}/{graph}/claimed-{n}", str(n)):
                return n

    def snapshot_dir(self, graph: str, sid: int) -> str:
        return f"{self.root}/{graph}/snapshot_id={sid}"

    def write_snapshot(self, graph: str, sid: int, edges: DataFrame, nodes: DataFrame | None = None) -> str:
        at = self.snapshot_dir(graph, sid)
        edges.write.mode("overwrite").parquet(f"{at}/edges")
        if nodes is not None:
            nodes.write.mode("overwrite").parquet(f"{at}/nodes")
        self._write(f"{at}/{MARKER}", str(FORMAT_VERSION))
        return at

    def prune(self, graph: str, keep: set[int]) -> list[int]:
        """Deletes older snapshot folders, but only those that carry our marker file."""
        p, fs = self._path(f"{self.root}/{graph}")
        gone = []
        for s in fs.listStatus(p) if fs.exists(p) else []:
            m = re.fullmatch(SNAPSHOT, s.getPath().getName())
            if m and int(m[1]) not in keep and self._read(f"{self.root}/{graph}/{m[0]}/{MARKER}") is not None:
                fs.delete(s.getPath(), True)
                gone.append(int(m[1]))
        for n in self._numbered(graph, CLAIM)[:-1]:
            fs.delete(self._path(f"{self.root}/{graph}/claimed-{n}")[0], False)
        return sorted(gone)

    def remove(self, graph: str) -> None:
        self.prune(graph, set())
        names = [f"manifest-{n}.json" for n in self._numbered(graph, MANIFEST)] + [f"claimed-{n}" for n in self._numbered(graph, CLAIM)]
        for name in reversed(names):
            p, fs = self._path(f"{self.root}/{graph}/{name}")
            fs.delete(p, False)
