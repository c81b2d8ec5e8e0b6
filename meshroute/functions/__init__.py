"""Part of meshroute."""
