"""The poll cycle as a stream over a landing folder."""
