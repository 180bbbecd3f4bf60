"""Rule packs, retrieval and assembly, and the registered queries."""
