"""Queries over the driver's tables; importing the package registers them all in codec.QUERIES."""

from . import codec, images, training  # noqa: F401
