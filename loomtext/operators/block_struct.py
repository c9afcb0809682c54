"""The struct that every block splitter returns."""

KINDS = ("function_def", "loops", "conditionals", "assignments", "others")
BLOCKS = "ok boolean, " + ", ".join(f"{k} array<string>" for k in KINDS)


def blank(ok: bool) -> dict:
    return {"ok": ok} | {k: [] for k in KINDS}
