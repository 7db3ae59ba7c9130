"""Connected components of links, as the engine's operators find them."""

from larkspur.operators.components import BY_ID, components

__all__ = ["BY_ID", "components"]
