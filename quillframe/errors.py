"""One error type for everything a user can get wrong."""


class UserError(ValueError):
    """A bad option, schema, expression or cell."""
