"""The table facade, which declares plans and runs none but where it says so."""
