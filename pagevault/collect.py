"""python -m pagevault.collect PATCH LOCALE URL [ROOT]: fetches one page, stores it, and reports what was stored.

Without ROOT, pages go to data/raw/pages beside the package.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pagevault.operators import report_lines
from pagevault.service import session
from pagevault.shared import use_checkpoints
from pagevault.sinks import save_pages
from pagevault.sources import fetch_pages, targets


def default_root() -> str:
    return str(Path(__file__).resolve().parents[1] / "data" / "raw" / "pages")


def main(args: list[str]) -> int:
    patch, locale, url, root = [*args, default_root()][:4]
    spark = session("pagevault.collect")
    use_checkpoints(spark)
    pages = fetch_pages(targets(spark, [(patch, locale, url)])).checkpoint()  # one fetch, however often it is read
    print("\n".join(r.line for r in report_lines(save_pages(pages, root)).sort("n").collect()))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
