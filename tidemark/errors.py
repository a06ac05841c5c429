"""Exceptions as one line of a result document."""

from __future__ import annotations

import re

_RAISED = re.compile(r"^[A-Za-z_][\w.]*(Error|Exception|Warning|Exit|Refused|Interrupt)(: .*)?$")


def first_line(e: BaseException) -> str:
    """What went wrong.  An error from a Python worker carries its trace: its last raise says it."""
    lines = [line.strip() for line in str(e).splitlines() if line.strip()]
    if any(line.startswith("Traceback (most recent call last)") for line in lines):
        raised = [line for line in lines if _RAISED.match(line)]
        if raised:
            return raised[-1]
    return lines[0] if lines else type(e).__name__
