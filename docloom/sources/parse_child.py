"""The child process of :class:`docloom.sources.corpus.ParseProcess`; it loads neither Spark nor pandas."""

from __future__ import annotations

import base64
import json
import os
import sys

from docloom.functions import fixed
from docloom.sources import images, parsers


def parse_path(root: str, rel: str) -> dict:
    """``{kind, units}`` of a file, or ``{skip}``."""
    path = os.path.join(root, rel)
    try:
        if not os.path.isfile(path):
            raise parsers.Skip("not a regular file")
        if os.path.getsize(path) > fixed.MAX_BYTES:
            raise parsers.Skip("too large")
        if parsers.kind_of(rel) is None:
            raise parsers.Skip("unknown type")
        with open(path, "rb") as file:
            kind, units = parsers.parse(rel, file.read())
        return {"kind": kind, "units": units}
    except parsers.Skip as reason:
        return {"skip": str(reason)}
    except PermissionError:
        return {"skip": "permission denied"}
    except Exception as error:  # a row for every file, whatever its parser does
        return {"skip": f"{type(error).__name__}: {error}"}


def render_path(root: str, rel: str) -> dict:
    """``{pages}`` of an image or a PDF file, pairs of number and PNG in base64, or ``{skip}``."""
    try:
        with open(os.path.join(root, rel), "rb") as file:
            pages = images.corpus_pages(rel, file.read())
            return {"pages": [(number, base64.b64encode(png).decode()) for number, png in pages]}
    except parsers.Skip as reason:
        return {"skip": str(reason)}
    except Exception as error:  # a row for every file, whatever its library does
        return {"skip": f"{type(error).__name__}: {error}"}


def main(root: str) -> None:
    replies, sys.stdout = sys.stdout, sys.stderr  # what a parser prints stays off the channel
    for line in sys.stdin:
        task, rel = json.loads(line)
        replies.write(json.dumps({"parse": parse_path, "render": render_path}[task](root, rel)) + "\n")
        replies.flush()


if __name__ == "__main__":
    main(sys.argv[1])
