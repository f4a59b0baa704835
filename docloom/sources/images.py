"""Images as models take them; needs an optional imaging library, and another one for PDF pages."""

from __future__ import annotations

import io
from collections.abc import Iterator

from docloom.functions import fixed
from docloom.sources.parsers import Skip, kind_of

SCANNED_PAGES, SCALE = 8, 2


def scaled_size(width: int, height: int, least: int, most: int) -> tuple[int, int]:
    """The size with its longer side between ``least`` and ``most``, the shape kept."""
    longest = max(width, height)
    target = min(max(longest, least), most)
    if target == longest:
        return width, height
    return max(1, round(width * target / longest)), max(1, round(height * target / longest))


def load_image(data: bytes, least: int = fixed.OCR_MIN_SIDE, most: int = fixed.OCR_MAX_SIDE):
    """The first frame, upright, eight bits a channel, without transparency, in the models' sizes."""
    try:
        import numpy as np
        from PIL import Image, ImageOps
    except ImportError as error:
        raise Skip("image support is not installed") from error
    image = Image.open(io.BytesIO(data))
    if getattr(image, "n_frames", 1) > 1:
        image.seek(0)
    if image.mode.startswith(("I", "F")):  # deep grey values are spread over eight bits
        grey = np.asarray(image, np.float32)
        image = Image.fromarray(((grey - grey.min()) / (np.ptp(grey) + 1e-6) * 255).astype(np.uint8))
    image = ImageOps.exif_transpose(image)
    if "A" in image.getbands() or "transparency" in image.info:
        layer = image.convert("RGBA")
        image = Image.alpha_composite(Image.new("RGBA", layer.size, "white"), layer)
    image = image.convert("RGB")
    size = scaled_size(*image.size, least, most)
    return image if size == image.size else image.resize(size, Image.Resampling.LANCZOS)


def scanned_pages(data: bytes, most: int = SCANNED_PAGES) -> Iterator[tuple[int, object]]:
    """(number, image) of the first pages of a PDF file."""
    try:
        import pypdfium2
    except ImportError as error:
        raise Skip("pdf rendering is not installed") from error
    with pypdfium2.PdfDocument(data) as document:
        for i in range(min(most, len(document))):
            yield i + 1, document[i].render(scale=SCALE).to_pil().convert("RGB")


def _png(image) -> bytes:
    out = io.BytesIO()
    image.save(out, "PNG")
    return out.getvalue()


def corpus_pages(name: str, data: bytes) -> Iterator[tuple[int, bytes]]:
    """(number, PNG) of what a transcriber is to read of a corpus file: an image, or a PDF file's first pages."""
    pages = ((n, _png(page)) for n, page in scanned_pages(data)) if kind_of(name) == "pdf" else [(1, data)]
    for number, page in pages:
        yield number, _png(load_image(page, fixed.CORPUS_MIN_SIDE))
