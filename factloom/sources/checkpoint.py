"""Row shards of a run: one JSON file a row, a manifest, and a gapless prefix of finished rows."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from . import digests
from .records import DataError, replace_file

VERSION = 3


def _flat(objects: object) -> bool:
    return isinstance(objects, list) and all(isinstance(x, str) for x in objects)


def _is_map(value: object) -> bool:
    return isinstance(value, dict)


def _is(wanted: object) -> Callable[[object], bool]:
    return lambda value: type(value) is type(wanted) and value == wanted


class RowShards:
    """Finished rows of one run in a folder that every process of the run can reach."""

    def __init__(self, root: str | Path, config: dict, keys: list[tuple[str, str]]) -> None:
        self.root, self.keys = Path(root), keys
        self.manifest = {
            "version": VERSION,
            "config": config,
            "config_sha256": digests.value_digest(config),
            "input_sha256": digests.value_digest([list(k) for k in keys]),
            "total_rows": len(keys),
        }

    @property
    def manifest_path(self) -> Path:
        return self.root / "manifest.json"

    def path(self, index: int) -> Path:
        """Where a row's shard is."""
        return self.root / "rows" / f"{index:06d}.json"

    def open(self) -> None:
        """Write the manifest, or check that the present one is of the same run."""
        if not self.manifest_path.exists():
            (self.root / "rows").mkdir(parents=True, exist_ok=True)
            replace_file(self.manifest_path, [json.dumps(self.manifest, ensure_ascii=False, indent=2).encode()])
        elif json.loads(self.manifest_path.read_text(encoding="utf-8")) != self.manifest:
            raise DataError("the manifest of the stored rows does not match this configuration and input")

    def problem(self, index: int, record: object) -> str | None:
        """What is wrong with a shard, if anything: the first place whose value is not what this row's has."""
        subject, relation = self.keys[index]
        own = {"SubjectEntity": subject, "Relation": relation}
        wanted: list[tuple[tuple[str, ...], Callable[[object], bool]]] = [((), _is_map), (("version",), _is(VERSION)), (("row_index",), _is(index))]
        wanted += [((k,), _is(v)) for k, v in own.items()]
        for part, fields in (("prediction", own), ("raw", own | {"row_index": index})):
            wanted += [((part,), _is_map), *(((part, k), _is(v)) for k, v in fields.items())]
        wanted.append((("prediction", "ObjectEntities"), _flat))
        for place, fits in wanted:
            value = record
            for step in place:
                value = value.get(step) if isinstance(value, dict) else None
            if not fits(value):
                return f"does not fit its row at {'.'.join(place) or 'its root'}"
        return None

    def load(self) -> list[dict]:
        """Records of the finished rows, which must be the first rows without a gap."""
        if not self.manifest_path.exists():
            return []
        self.open()
        found = sorted((self.root / "rows").glob("[0-9]" * 6 + ".json"))
        if len(found) > len(self.keys):
            raise DataError("more stored rows than input rows")
        records = []
        for index, path in enumerate(found):
            if path != self.path(index):
                raise DataError(f"stored rows are not a contiguous prefix; expected {self.path(index)}")
            record = json.loads(path.read_text(encoding="utf-8"))
            said = self.problem(index, record)
            if said:
                raise DataError(f"row shard {path} {said}")
            records.append(record)
        return records

    def write(self, index: int, prediction: dict, raw: dict) -> None:
        """Store a row for good; the same row again is fine, another one is an error."""
        subject, relation = self.keys[index]
        record = {"version": VERSION, "row_index": index, "SubjectEntity": subject, "Relation": relation, "prediction": prediction, "raw": raw}
        path = self.path(index)
        if not path.exists():
            replace_file(path, [json.dumps(record, ensure_ascii=False, indent=2).encode()])
        elif json.loads(path.read_text(encoding="utf-8")) != record:
            raise DataError(f"refusing to overwrite a different row shard {path}")
