class XmlError(ValueError):
    """A report file that cannot be parsed."""


class PlanError(ValueError):
    """A pipeline that cannot be planned: unknown types, ambiguous names, incomparable columns."""


class MergeError(ValueError):
    """Tables whose columns of one name differ in type."""
