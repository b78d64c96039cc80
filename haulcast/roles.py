"""Column roles: what each column of a table is used for."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Roles:
    """Names of the columns that play a part in a regression task."""

    target: str
    row_id: str
    id: str
    entity: str
    order_date: str
    delivery_date: str
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()
    is_train: str = "is_train"
    extra: tuple[str, ...] = field(default=())

    def columns(self) -> list[str]:
        named = [self.row_id, self.id, self.entity, self.order_date, self.delivery_date,
                 *self.numeric, *self.categorical, *self.flags, self.target, self.is_train, *self.extra]
        return list(dict.fromkeys(named))

    def with_numeric(self, *names: str) -> "Roles":
        return replace(self, numeric=tuple(dict.fromkeys(self.numeric + names)))

    def with_categorical(self, *names: str) -> "Roles":
        """Treat more columns, such as month or weekday numbers, as categories."""
        return replace(self, categorical=tuple(dict.fromkeys(self.categorical + names)))


SHIPMENTS = Roles(
    target="transport_cost",
    row_id="row_id",
    id="hospital_id",
    entity="hospital_id",
    order_date="order_placed_date",
    delivery_date="delivery_date",
    numeric=("supplier_reliability", "equipment_height", "equipment_width", "equipment_weight",
             "equipment_value", "base_transport_fee"),
    categorical=("supplier_name", "equipment_type", "transport_method", "hospital_info", "hospital_location"),
    flags=("crossborder_shipping", "urgent_shipping", "installation_service", "fragile_equipment",
           "rural_hospital"),
)
