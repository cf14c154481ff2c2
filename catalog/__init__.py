"""Named queries over the driver's tables, each with its SQL where SQL can say it."""

MODULES = ["relational", "code", "datasets", "intake"]


def load() -> None:
    from importlib import import_module

    for name in MODULES:
        import_module(f"catalog.{name}")
