"""Column names that clash with none of a table."""


def free_names(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many "_" behind it as it takes to be none of ``columns``, in any case of letters."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
