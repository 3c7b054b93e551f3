"""Operators on triples (h, r, t), alignment pairs (e1, e2) and members (part_id, ent)."""
