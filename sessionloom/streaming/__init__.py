"""Left empty on purpose: the feature work rebuilt here is batch only.

The session key is given in the data and no step keeps state between batches, so there is no
streaming operator to offer (see the README).
"""
