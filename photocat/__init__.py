"""photocat - a photo-library catalog engine built on Spark DataFrames.

Every operator takes DataFrames and returns a DataFrame.  One DataFrame may
hold any number of scan roots; a root (a card, a folder tree) is never assumed
to be small.
"""

from photocat.schema import LABELS, STATUSES, PHOTOS_SCHEMA, SCHEMA_VERSION

__all__ = ["LABELS", "STATUSES", "PHOTOS_SCHEMA", "SCHEMA_VERSION"]
