"""lineup: entity re-identification analytics as Spark jobs.

Vocabulary used across the package:

* item    one observation (an image crop), identified by its path or id
* entity  one individual
* group   the account that owns entities; the unit of splits and of leakage
* source  the device an item came from
* corpus  which collection the item belongs to
* role    ``query`` or ``gallery``
* case    one question: a query item and an ordered gallery, with a label
"""
