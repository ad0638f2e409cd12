"""Training-data pipeline operators (licences, language, near duplicates, privacy, tokens, archives, packing, search).

Nothing outside this subpackage imports it; it may be removed together with its tests.
"""
