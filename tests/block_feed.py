"""A feed of seven blocks, for the live source."""

ROWS = [(i, f"{i}a", f"{i - 1}a", max(0, i - 2), f"w{i}") for i in range(1, 8)]


def blocks(at: int, limit: int) -> list[tuple]:
    return ROWS[at : at + limit]
