"""The function library, by structure: `library["String"]["size"]` is a function of Columns (or of functions of Columns)."""

from lumenrel.functions import collections, more, scalars, text, values

library: dict[str, dict] = {}
for _module in (collections, scalars, text, values, more):
    for _name, _structure in _module.STRUCTURES.items():
        library.setdefault(_name, {}).update(_structure)


def lookup(name: str):
    """`Structure.function`, e.g. Int.mod."""
    structure, _, function = name.partition(".")
    return library[structure][function]
