"""What a deployment may set: secrets, header names and limits."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Options of request admission and enrichment.

    ``hmac_secret``      secret of signed URLs; without one signatures are not checked
    ``hmac_log_only``    let requests with a bad signature pass
    ``trust_proxy``      take the client address from ``X-Forwarded-For``
    ``start_header``     header with the client's send time in epoch milliseconds
    ``sink_has_token``   the sink authenticates on its own: drop ``token`` when forwarding
    ``sink_wait``        ask the sink to confirm writes
    ``trace_project``    project name for trace links
    ``broadcast_rows``   rows of the largest lookup table that is broadcast, and
    ``broadcast_bytes``  its bytes; tables beyond either are shuffled
    ``task_rows``        rows of one key that a task of such a shuffle may get
    """

    hmac_secret: str | None = None
    hmac_log_only: bool = False
    trust_proxy: bool = True
    start_header: str = "x-analytics-start"
    sink_has_token: bool = False
    sink_wait: bool = False
    trace_project: str | None = None
    broadcast_rows: int = 500_000
    broadcast_bytes: int = 64 << 20
    task_rows: int = 200_000
