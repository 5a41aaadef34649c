"""python -m prefixlens.cli.receive --output requests.ndjson"""

from __future__ import annotations

import argparse
import signal
import threading
from pathlib import Path

from prefixlens.options import ReceiverOptions
from prefixlens.sources.landing import NdjsonAppender
from prefixlens.sources.receiver import make_server


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--output", required=True)
    p.add_argument("--listen")
    p.add_argument("--config")
    p.add_argument("--max-payload-bytes", type=int)
    a = p.parse_args(argv)
    base = ReceiverOptions.from_json(Path(a.config).read_text()) if a.config else ReceiverOptions()
    options = ReceiverOptions(listen=a.listen or base.listen, max_payload_bytes=a.max_payload_bytes or base.max_payload_bytes)
    with NdjsonAppender(a.output) as appender, make_server(appender, options) as server:
        stop = lambda *_: threading.Thread(target=server.shutdown).start()
        signal.signal(signal.SIGINT, stop)
        signal.signal(signal.SIGTERM, stop)
        server.serve_forever()


if __name__ == "__main__":
    main()
