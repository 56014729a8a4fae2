"""Line protocol: ``python -m cborlake encode|decode-strict --profile P``, a value or item for each line of stdin.

Each line gives one line, empty on error. Exit: 0; 1 if a line was in error; 2 for bad arguments; 3 for an unknown profile.
"""

from __future__ import annotations

import sys

from .functions import codec
from .functions.columns import PROFILES


def answer(mode: str, line: str, profile: str) -> str:
    if mode == "encode":
        return codec.encode_json(line, profile).hex()
    if not codec._HEX.fullmatch(line):
        raise codec.Malformed("hexadecimal")
    verdict, reason, canonical = codec.decode_strict(bytes.fromhex(line), profile)
    if verdict == "ERROR":
        raise codec.Malformed(line)
    return f"{verdict} {reason or canonical.hex()}"


def main(args: list[str]) -> int:
    profile = args[args.index("--profile") + 1] if "--profile" in args[:-1] else None
    if not args or args[0] not in ("encode", "decode-strict") or profile is None:
        print("usage: encode|decode-strict --profile P", file=sys.stderr)
        return 2
    if profile not in PROFILES:
        print(f"unknown profile {profile}", file=sys.stderr)
        return 3
    failed = 0
    for line in map(str.strip, sys.stdin):
        if not line:
            continue
        try:
            print(answer(args[0], line, profile))
        except codec.Malformed as e:
            print(e, file=sys.stderr)
            print()
            failed = 1
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
