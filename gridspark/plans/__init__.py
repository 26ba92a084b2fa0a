"""End-to-end flows: each is one lazy plan made of operators."""
