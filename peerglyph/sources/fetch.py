"""Inputs that are fetched once and kept (Unicode files, mostly)."""

from __future__ import annotations

import os
import shutil
import urllib.request
import uuid


def ensure_file(url: str, folder: str, name: str | None = None, timeout: float = 60) -> str:
    """The path of a file in ``folder``, fetched from ``url`` if it isn't there yet; a failed fetch leaves nothing.

    Runs on the driver; on a cluster the folder is one that executors share.
    """
    path = os.path.join(folder, name or url.rsplit("/", 1)[-1])
    if os.path.exists(path):
        return path
    os.makedirs(folder, exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer, open(part, "wb") as out:  # an answer of another kind than 200 raises
            shutil.copyfileobj(answer, out)
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return path
