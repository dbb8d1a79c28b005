"""Writers with refuse-or-replace semantics."""
