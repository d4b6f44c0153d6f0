"""What the tests of definitions and of the engine share."""

import copy

WELLS = {
    "schema_version": 1,
    "fields": [{"name": "tag", "type": "string", "nullable": True, "max_length": 6}, {"name": "depth", "type": "decimal", "nullable": False, "precision": 9, "scale": 2}],
    "geometry": {"type": "Point", "srid": 3857, "dimensions": "XYZ", "nullable": False, "allow_empty": False, "require_valid": True},
}


def changed(definition, path, value):
    """A copy with one part replaced."""
    out = copy.deepcopy(definition)
    at = out
    for step in path[:-1]:
        at = at[step]
    at[path[-1]] = value
    return out


def without(definition, path):
    out = copy.deepcopy(definition)
    at = out
    for step in path[:-1]:
        at = at[step]
    del at[path[-1]]
    return out
