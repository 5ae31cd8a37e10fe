"""Raw files that come zipped."""

from __future__ import annotations

import os
import shutil
import zipfile
from pathlib import Path


def extract_if_zipped(path: str | Path) -> Path:
    """The file itself; if only ``<file>.zip`` is there, its member of the same name is unpacked beside it and the archive removed.

    The member appears whole or not at all. A missing archive or member raises FileNotFoundError.
    """
    path = Path(path)
    archive = path.with_name(path.name + ".zip")
    if path.exists():
        return path
    if not archive.exists():
        raise FileNotFoundError(f"neither {path} nor {archive} is there")
    with zipfile.ZipFile(archive) as z:
        if path.name not in z.namelist():
            raise FileNotFoundError(f"{archive} has no member {path.name}")
        part = path.with_name(f".{path.name}.part")
        with z.open(path.name) as source, part.open("wb") as target:
            shutil.copyfileobj(source, target)
    os.replace(part, path)
    archive.unlink()
    return path
