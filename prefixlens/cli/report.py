"""python -m prefixlens.cli.report --input analysis.json --output report"""

from __future__ import annotations

import argparse

from prefixlens.cli.analyse import session
from prefixlens.report import locale
from prefixlens.report.output import FORMATS, write_reports


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--format", choices=[*FORMATS])
    p.add_argument("--locale", default="en-US")
    a = p.parse_args(argv)
    locale.set_locale(a.locale)
    for path in write_reports(session("report"), a.input, a.output, a.format):
        print(path)


if __name__ == "__main__":
    main()
