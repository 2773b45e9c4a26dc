"""A parser for tests: pages are lines; it notes each range that it reads beside the file."""

import os
import uuid


class LineParser:
    def count(self, path):
        with open(path) as f:
            lines = f.read().split("\n")
        if lines == ["broken"]:
            raise ValueError("no pages")
        return len(lines) if lines != [""] else 0

    def pages(self, path, first, last):
        with open(path) as f:
            lines = f.read().split("\n")
        log = os.path.join(os.path.dirname(path), "log")
        os.makedirs(log, exist_ok=True)
        open(os.path.join(log, f"{os.path.basename(path)}-{first}-{last}-{uuid.uuid4().hex}"), "w").close()
        for k in range(first, last):
            if lines[k] == "torn":
                raise OSError("a torn page")
            yield lines[k]
